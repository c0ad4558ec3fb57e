"""Personal data replaced by surrogates, in DataFrame operations alone.

An entity found in the text is normalised (case and separators go), and a keyed hash of the normal form draws a surrogate of
its own type and format: digits for digits, letters for letters of the same case, hexadecimal for hexadecimal, octets from
1 to 254, a check digit that holds, the same country code, key prefix or top-level domain.  Long numbers are cards only if
their check digit holds.  Persons (a title and one or two names) keep the title; a given name has one surrogate in the whole
corpus, which ends as fits the gender that the titles before it tell, and both names keep the script.  The same entity gets
the same surrogate in all documents and formats (coreference).  Given and family name together are replaced wherever they
stand once a title has told the person anywhere in the corpus, the family name alone in documents that name the person.

Distinctness is checked over all documents: where a surrogate was drawn for two entities of a type, or is itself an entity
of the corpus, all but the first draw again, with the next number.  After every `GROW` draws a surrogate gets one character
(octet, syllable) more, so that crowded formats run out for none, and rounds end only when no two are equal.

Defined results: a null text stays null and has no entities; an empty text stays empty; texts of any length are searched
whole; where two types match at one place, the first in `PATTERNS` holds, and matches do not overlap (the leftmost holds); a
family name alone is taken for the person's even where it could be another word; repeated rows get the same result; an empty
table gives no rows; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simforge.llm.common import cut, fresh, table

#: The key of the registered query; who has texts to protect passes a secret one.
KEY = "simforge surrogate key 1"
#: So many draws are made before surrogates get one character longer.
GROW = 8
#: Titles that tell a gender, and those that don't.
MALE = ("Mr", "Sir", "Herr", "Señor", "Monsieur")
FEMALE = ("Mrs", "Ms", "Miss", "Lady", "Frau", "Señora", "Madame")
OTHER = ("Dr", "Prof")
_TITLES = "|".join(sorted((*MALE, *FEMALE, *OTHER), key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|\d{1,2})"
#: Type, pattern, and what each text with a match has somewhere; where two patterns match at one place, the first holds.
PATTERNS = (
    ("secret", r"""(?<![\p{L}\d])(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)["']?\s{0,3}[=:]\s{0,3}["']?[^\s"',;]{6,}""", r"(?i:password|passwd|pwd|token|secret|key)"),
    ("access_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])", r"A[KS]IA"),
    ("email", r"(?<![\p{L}\d_.+%-])[\p{L}\d_.+%-]{1,64}@[\p{L}\d-]{1,63}(?:\.[\p{L}\d-]{1,63}){1,8}", "@"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"\d"),
    ("mac", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])", r"[0-9A-Fa-f][:-][0-9A-Fa-f]{2}[:-]"),
    ("ipv6", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"),
    ("ipv4", rf"(?<![\d.])(?<!(?i:version|release|ver|v)[. ]{{0,2}})(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)", r"\d"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", r"\d"),
    ("phone", r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,12}(?!\d)|(?<![\d.])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)|(?<![\d.,/-])0\d{2,4}[ /-]\d{6,8}(?![\d/-]|[.,]\d)", r"\d"),
    ("card", r"(?<!\d)(?:(?:\d{4}[ -]){3}\d{1,7}|\d{13,19})(?!\d)", r"\d"),
    ("person", rf"(?<!\p{{L}})(?:{_TITLES})\.? \p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+)?", rf"(?:{_TITLES})[. ]"),
)
ANY = "|".join(f"(?:{p})" for _, p, _ in PATTERNS)
#: A text without a match of this has no entity.
HINT = "|".join(sorted({h for _, _, h in PATTERNS}))
#: Two capitalised words in a row, at each place where they stand.
PAIR = r"(?<!\p{L})(?=(\p{Lu}\p{L}+ \p{Lu}\p{L}+)(?!\p{L}))"
_HEAD = r"""^.*?[=:]\s{0,3}["']?"""
#: Consonants and vowels of the scripts that names are made in.
SCRIPTS = {
    "latin": ("bcdfglmnprstvz", "aeiou"),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу"),
    "greek": ("βγδζκλμνπρστ", "αειου"),
}


def _digits(stream: str, i: Column | int, n: int) -> Column:
    """A number below n for the i-th place (from 0) out of a column of 256 hexadecimal digits."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.pmod(F.conv(F.substr(F.col(stream), (F.pmod(i, F.lit(64)) * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int") + F.floor(i / 64).cast("int") * 7, F.lit(n))


def _pick(alphabet: str, at: Column) -> Column:
    return F.substr(F.lit(alphabet), (at + 1).cast("int"), F.lit(1))


def kind_of(match: Column) -> Column:
    """The type of a match: that of the first pattern that fits it from end to end."""
    out = F.lit("person")
    for name, pattern, _ in reversed(PATTERNS):
        out = F.when(match.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def check_digit(digits: Column) -> Column:
    """The Luhn check digit of digits."""
    n = F.length(digits)

    def each(c: Column, i: Column) -> Column:
        twice = c.cast("int") * 2
        return F.when(F.pmod(n - i, F.lit(2)) == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(c.cast("int"))

    total = F.aggregate(F.transform(F.split(digits, ""), each), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def _head(digits: Column) -> Column:
    return F.substr(digits, F.lit(1), F.length(digits) - 1)


def described(matches: DataFrame) -> DataFrame:
    """matches (match) with kind, body (what is replaced of it), norm (the same for all ways to write it) and keep (how many leading characters of norm a surrogate keeps); of persons given, family and what the title tells of the gender (m, f or null).  Numbers whose check digit fails have the kind none."""
    kind, body = F.col("kind"), F.col("body")
    m = matches.withColumn("kind", kind_of(F.col("match")))
    m = m.withColumn("body", F.when(kind == "secret", F.regexp_replace("match", _HEAD, "")).when(kind == "person", F.regexp_replace("match", rf"^(?:{_TITLES})\.? ", "")).otherwise(F.col("match")))
    bare = F.regexp_replace("body", r"[^0-9A-Za-z]", "")
    m = m.withColumn("norm", F.when(kind.isin("phone", "card", "ssn", "iban"), bare).when(kind == "mac", F.lower(F.regexp_replace("body", "-", ":"))).when(kind.isin("email", "ipv6"), F.lower("body")).otherwise(body))
    holds = F.substr("norm", F.length("norm"), F.lit(1)) == check_digit(_head(F.col("norm")))
    m = m.withColumn("kind", F.when((kind == "card") & ~holds, "none").otherwise(kind))
    code = F.length(F.regexp_extract("body", r"^\+(\d{1,3}?)(?:[ .(-]|\d{6,}$)", 1))
    m = m.withColumn("keep", F.when(kind == "access_key", 4).when(kind == "iban", 2).when(kind == "phone", code).when(kind == "card", 1).otherwise(0).cast("int"))
    title = F.regexp_extract("match", rf"^({_TITLES})", 1)
    person = kind == "person"
    m = m.withColumn("family", F.when(person, F.substring_index("body", " ", -1))).withColumn("given", F.when(person & body.contains(" "), F.substring_index("body", " ", 1)))
    return m.withColumn("gender", F.when(person & title.isin(*MALE), "m").when(person & title.isin(*FEMALE), "f"))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, norm, keep, attempt) with new, the surrogate of norm; kinds given-m, given-f, given-n and family are names."""
    kind, norm = F.col("kind"), F.col("norm")
    seed = F.concat_ws("|", F.lit(key), kind, F.col("attempt").cast("string"), norm)
    e = entities.withColumn("seed", seed).withColumn("stream", F.concat(F.sha2("seed", 512), F.sha2(F.concat("seed", F.lit("|2")), 512)))
    # digits for digits, letters for letters of the same case, after keep characters and before the last label of an address
    e = e.withColumn("hexa", kind.isin("mac", "ipv6") | ((kind == "secret") & norm.rlike("^[0-9a-f]+$")))
    e = e.withColumn("last", F.length("norm") - F.when(kind == "email", F.length(F.substring_index("norm", ".", -1)) + 1).otherwise(0))

    def letter(i: Column) -> Column:
        return _pick("abcdefghijklmnopqrstuvwxyz", F.when(F.col("hexa"), _digits("stream", i, 6)).otherwise(_digits("stream", i, 26)))

    def one(c: Column, i: Column) -> Column:
        new = F.when(c.rlike(r"\d"), _digits("stream", i, 10).cast("string")).when(c.rlike(r"\p{Lu}"), F.upper(letter(i))).when(c.rlike(r"\p{L}"), letter(i)).otherwise(c)
        return F.when((i < F.col("keep")) | (i >= F.col("last")), c).otherwise(new)

    longer = F.floor(F.col("attempt") / GROW).cast("int")
    each = lambda f: F.array_join(F.transform(F.when(longer > 0, F.sequence(F.lit(1), longer)).otherwise(F.array().cast("array<int>")), lambda j: f(j + 40)), "")
    digits = each(lambda i: _digits("stream", i, 10).cast("string"))
    e = e.withColumn("more", F.when(kind.isin("phone", "card", "ssn", "iban"), digits).when(kind == "ipv4", each(lambda i: F.concat(F.lit("."), (_digits("stream", i, 254) + 1).cast("string")))).otherwise(each(letter)))
    drawn = F.array_join(F.transform(F.split("norm", ""), one), "")
    e = e.withColumn("drawn", F.when(kind == "card", _head(drawn)).otherwise(drawn))
    octets = F.concat_ws(".", *[(_digits("stream", i, 254) + 1).cast("string") for i in range(4)])

    def name(consonants: str, vowels: str) -> Column:
        """Three syllables or more and an ending of the gender; without one, a consonant."""
        syllable = lambda i: F.concat(_pick(consonants, _digits("stream", 2 * i, len(consonants))), _pick(vowels, _digits("stream", 2 * i + 1, len(vowels))))
        end = F.when(kind == "given-f", vowels[0]).when(kind == "given-m", vowels[3]).otherwise("")
        return F.initcap(F.concat(*[syllable(i) for i in range(3)], each(syllable), _pick(consonants, _digits("stream", 6, len(consonants))), end))

    names = F.when(norm.rlike(r"^\p{IsCyrillic}"), name(*SCRIPTS["cyrillic"])).when(norm.rlike(r"^\p{IsGreek}"), name(*SCRIPTS["greek"])).otherwise(name(*SCRIPTS["latin"]))
    card = F.concat("drawn", "more")
    new = F.when(kind.startswith("given-") | (kind == "family"), names).when(kind == "ipv4", F.concat(octets, "more")).when(kind == "card", F.concat(card, check_digit(card))).when(kind == "email", F.concat("more", "drawn")).otherwise(F.concat("drawn", "more"))
    return e.withColumn("new", new).select(*entities.columns, "new")


def distinct_surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, norm, new) for the entities (kind, norm, keep), no two of a kind with the same new, and none whose new is an entity.

    Each round draws for all entities with their present number; a surrogate of several entities stays with the one of the
    least hash, and one that is an entity of the corpus with none.  What has no letter or digit to change stays as it is.
    """
    now = cut(surrogates(entities.groupBy("kind", "norm").agg(F.max("keep").alias("keep")).withColumn("attempt", F.lit(0)), key))
    while True:
        real = now.select(F.col("kind").alias("k"), F.col("norm").alias("r"))
        order = F.struct(F.xxhash64("norm").alias("h"), F.col("norm").alias("n"))
        first = now.groupBy(F.col("kind").alias("k2"), F.col("new").alias("new2")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("many"))
        first = first.join(real, (F.col("k2") == F.col("k")) & (F.col("new2") == F.col("r")), "left").withColumn("taken", F.col("k").isNotNull()).where("many > 1 or taken").select("k2", "new2", "first", "taken")
        bad = (F.length(F.regexp_replace("norm", r"[^\p{L}\d]", "")) > F.col("keep")) & (F.col("taken") | (F.col("first") != order))
        wrong = now.join(first, (F.col("kind") == F.col("k2")) & (F.col("new") == F.col("new2"))).where(bad).select("kind", "norm", "keep", "attempt")
        again = cut(surrogates(wrong.withColumn("attempt", F.col("attempt") + 1), key))
        if again.isEmpty():
            return now.select("kind", "norm", "new")
        now = cut(now.join(again.select("kind", "norm"), ["kind", "norm"], "left_anti").unionByName(again))


def replacements(matches: DataFrame, key: str = KEY) -> DataFrame:
    """For the distinct matches (match): kind, text (what stands in its place), and of persons given, family and their surrogates given_new, family_new."""
    m = cut(described(matches))
    entity = lambda df, kind, norm, keep: df.select(kind.alias("kind"), norm.alias("norm"), keep.cast("int").alias("keep"))
    whole = entity(m, F.col("kind"), F.col("norm"), F.col("keep")).where("kind not in ('person', 'none')")
    # what all titles before a given name tell together
    told = m.where("given is not null").groupBy(F.col("given").alias("g")).agg(F.min("gender").alias("a"), F.max("gender").alias("b"))
    told = told.select("g", F.concat(F.lit("given-"), F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("n")).alias("g_kind"))
    names = entity(told, F.col("g_kind"), F.col("g"), F.lit(0)).union(entity(m, F.lit("family"), F.col("family"), F.lit(0)).where("norm is not null"))
    new = distinct_surrogates(whole.union(names), key)
    look = lambda a, b, c: new.select(F.col("kind").alias(a), F.col("norm").alias(b), F.col("new").alias(c))
    m = m.join(look("k1", "n1", "new"), (F.col("kind") == F.col("k1")) & (F.col("norm") == F.col("n1")), "left")
    m = m.join(look("k2", "n2", "given_new").where("k2 like 'given-%'"), F.col("given") == F.col("n2"), "left")
    m = m.join(look("k3", "n3", "family_new"), (F.col("k3") == "family") & (F.col("family") == F.col("n3")), "left")
    # written as the entity was: with its separators and capitals
    chars = F.split("body", "")
    bare = lambda c: F.length(F.regexp_replace(c, r"[^0-9A-Za-z]", ""))
    rank = lambda i: bare(F.substr(F.col("body"), F.lit(1), i + 1))
    spaced = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substr(F.col("new"), rank(i), F.lit(1))).otherwise(c)), "")
    spaced = F.concat(spaced, F.substr(F.col("new"), bare(F.col("body")) + 1, F.length("new")))
    kind = F.col("kind")
    extra = F.length("new") - F.length("body")
    shift = F.when(kind == "email", extra).otherwise(0)
    at = lambda i: F.substr(F.col("new"), i + 1 + shift, F.lit(1))
    cased = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(r"\p{Lu}"), F.upper(at(i))).when(c == "-", c).otherwise(at(i))), "")
    cased = F.concat(F.substr(F.col("new"), F.lit(1), shift), cased, F.substr(F.col("new"), F.length("body") + 1 + shift, extra))
    body = F.when(kind == "none", F.col("body")).when(kind.isin("phone", "card", "ssn", "iban"), spaced).when(kind.isin("email", "mac", "ipv6"), cased).when(kind == "person", F.concat_ws(" ", "given_new", "family_new")).otherwise(F.col("new"))
    head = F.substr(F.col("match"), F.lit(1), F.length("match") - F.length("body"))
    return m.select("match", "kind", F.concat(head, body).alias("text"), "given", "given_new", "family", "family_new")


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """docs with the text rewritten, n_entities (what was found, and persons named without a title only, each once) and entity_types (sorted, distinct; under these names or with underscores in front).

    Each text is searched once, and what was found is stored with it.  Texts without entities take no part in any exchange;
    the others meet their replacements by a digest of the text.
    """
    m, d, of, new_col, people_col, between, done = (fresh(docs, x) for x in ("pii_matches", "pii_digest", "pii_of", "pii_new", "pii_people", "pii_between", "pii_text"))
    text = F.col(f"`{text_col}`")
    none = F.array().cast("array<string>")
    found = cut(docs.withColumn(m, F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none)).withColumn(d, F.md5(text.cast("binary"))))
    lists = found.where(F.size(m) > 0).groupBy(F.col(d).alias("digest")).agg(F.first(m).alias("matches"))
    each = cut(lists.select("digest", F.posexplode("matches").alias("i", "match")))
    new = cut(replacements(each.select("match").distinct(), key).withColumnsRenamed({"match": "m2", "text": "t2"}))
    entry = F.struct("i", F.col("t2").alias("text"), "kind", "given", "family", "family_new")
    rows = each.join(new, F.col("match") == F.col("m2")).groupBy("digest").agg(F.array_sort(F.collect_list(entry)).alias("new"))
    persons = new.where("given is not null").select(F.concat_ws(" ", "given", "family").alias("a"), F.concat_ws(" ", "given_new", "family_new").alias("b"), "family", "family_new").distinct()
    mentions = None
    if not persons.isEmpty():  # names without a title, of persons known by one
        pairs = found.groupBy(F.col(d).alias("digest")).agg(F.first(text).alias("t")).select("digest", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(PAIR), F.lit(1)))).alias("pair"))
        both = F.array(F.struct(F.lit(0).alias("o"), "a", "b"), F.struct(F.lit(1).alias("o"), F.col("family").alias("a"), F.col("family_new").alias("b")))
        mentions = cut(pairs.join(persons, F.col("pair") == F.col("a")).groupBy("digest").agg(F.array_sort(F.flatten(F.collect_list(both))).alias("people")))
        rows = rows.join(mentions, "digest", "full")
    else:
        rows = rows.withColumn("people", F.lit(None).cast("array<struct<o:int,a:string,b:string>>"))
    rows = rows.select(F.col("digest").alias(of), F.col("new").alias(new_col), F.col("people").alias(people_col))
    outs = {c: fresh(docs, c) for c in ("n_entities", "entity_types")}

    def columns(out: Column, n: Column, types: Column) -> list[Column]:
        return [*[out.alias(c) if c.lower() == text_col.lower() else F.col(f"`{c}`") for c in docs.columns], n.cast("long").alias(outs["n_entities"]), types.cast("array<string>").alias(outs["entity_types"])]

    have = found if mentions is not None else found.where(F.size(m) > 0)
    joined = have.join(rows, F.col(d) == F.col(of)).withColumn(between, F.split(text, ANY, -1))
    found_here = F.coalesce(F.col(new_col), F.array().cast("array<struct<i:int,text:string,kind:string,given:string,family:string,family_new:string>>"))
    parts = F.transform(found_here, lambda x, i: F.concat(x["text"], F.element_at(between, (i + 2).cast("int"))))
    joined = joined.withColumn(done, F.concat(F.element_at(between, 1), F.array_join(parts, "")))
    here = F.transform(F.filter(found_here, lambda x: x["family"].isNotNull()), lambda x: F.struct(F.lit(1).alias("o"), x["family"].alias("a"), x["family_new"].alias("b")))
    people = F.array_sort(F.array_distinct(F.concat(here, F.coalesce(F.col(people_col), F.array().cast("array<struct<o:int,a:string,b:string>>")))))
    alone = F.aggregate(people, F.col(done), lambda t, p: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}\d@.])\Q"), p["a"], F.lit(r"\E(?![\p{L}\d@])")), p["b"]))
    kinds = F.filter(F.transform(found_here, lambda x: x["kind"]), lambda k: k != "none")
    titled = F.transform(found_here, lambda x: F.concat_ws(" ", x["given"], x["family"]))
    mentioned = F.coalesce(F.size(F.filter(F.col(people_col), lambda p: (p["o"] == 0) & ~F.array_contains(titled, p["a"]))), F.lit(0))
    kinds = F.concat(kinds, F.when(mentioned > 0, F.array_repeat(F.lit("person"), mentioned)).otherwise(none))
    changed = joined.select(*columns(alone, F.size(kinds), F.array_sort(F.array_distinct(kinds))))
    same = found.where((F.size(m) == 0) | F.col(m).isNull())
    if mentions is not None:
        same = same.join(mentions.select(F.col("digest").alias(of)), F.col(d) == F.col(of), "left_anti")
    return changed.unionByName(same.select(*columns(text, F.lit(0), none)))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs).select("doc_id", "text", "n_entities", F.array_join("entity_types", ",").alias("entity_types"))


QUERIES = {"op8_pii": op8_pii}
ORACLE: dict[str, str] = {}
