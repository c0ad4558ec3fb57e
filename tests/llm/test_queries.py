"""Each registered query on small tables, by its contract's columns: against SQL, brute force or what was planted."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from simforge.llm import pii, queries

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
    "pages": "page_id long, url string, html string",
}
ITEM = "which of the seven rivers named in the old atlas flows north past the stone bridge before it meets the sea"
PAGE = "<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><nav><a href=/>Home</a></nav><article><h1>%s</h1><p>%s &amp; more</p><ul><li>one</li></ul></article><div class=\"comments\">Nice</div><footer>f</footer></body></html>"


def prose(rng, low, high, words):
    return " ".join(rng.choices(words, k=rng.randint(low, high)))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(31)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(600)]
    docs, labels = [], []
    for i in range(240):
        text = prose(rng, 20, 90, words)
        toxic = i % 6 == 0
        if toxic:
            w = text.split()
            for k in (2, 5, 9):
                w[k] = rng.choice(["vileword", "vilewords", "nastyterm"])
            text = " ".join(w)
        labels.append((i, 1, int(toxic)))
        docs.append((i, text, "en", rng.choice(["a", "b", "c", "d"]), len(text)))
    base, shared = docs[1][1], prose(rng, 60, 60, words)
    docs += [(300, base, "en", "a", 1), (301, base + " tail", "en", None, 1), (302, prose(rng, 10, 10, words) + " " + shared, "en", "b", 1), (303, shared + " " + prose(rng, 30, 30, words), "en", "b", 1)]
    docs += [(310, prose(rng, 15, 30, words) + " " + ITEM + " " + prose(rng, 15, 30, words), "en", "a", 1), (311, "Write to Mr. Karl Moser, karl@moser.example or +1 (212) 555-0199.", "en", "a", 1)]
    docs += [(320, None, None, None, None), (321, "", "en", "a", 0), (322, "Ünï\tcode  wörds\n", "de", "é", 1), (323, "é" * 1000, "fr", "\U0001f600", 1000)]
    docs += [(330, "w " * 40_000, "en", "a", 80_000)]
    pages = [(i, f"http://h{i % 4}/x", PAGE % (f"Title {i}", prose(rng, 20, 60, words))) for i in range(30)] + [(90, None, None), (91, "u", "")]
    root = tmp_path_factory.mktemp("tables")
    for name, rows in (("documents", docs), ("labels", labels), ("benchmark", [(1, ITEM), (2, prose(rng, 20, 20, ["other", "thing", "never", "there"]))]), ("pages", pages)):
        spark.createDataFrame(rows, TABLES[name]).repartition(3).write.parquet(str(root / f"{name}.parquet"))
    return str(root), docs, labels, pages


@pytest.fixture(scope="module")
def run(spark, tables):
    return lambda name: [r.asDict() for r in queries.QUERIES[name](spark, tables[0]).collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(tables, run, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables[0]}/{t}.parquet/*.parquet'")
    got = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in got.description]
    key = lambda r: tuple(repr(round(x, 3) if isinstance(x, float) else x) for _, x in sorted(r.items()))
    want = Counter(key(dict(zip(columns, r))) for r in got.fetchall())
    assert Counter(key(r) for r in run(name)) == want


def test_op1(tables, run):
    rows, labels = run("op1_toxicity"), {i: t for i, _, t in tables[2]}
    assert {r["doc_id"] for r in rows} == {d[0] for d in tables[1]} and len(rows) == len(tables[1])
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == t for p, t in held) >= 0.95 * len(held)


def test_op1_learns_nothing_from_held_out_labels(spark, tables, tmp_path):
    """Turning all held-out labels round changes no score."""
    for t in ("documents", "benchmark", "pages"):
        spark.read.parquet(f"{tables[0]}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in tables[2]]
    spark.createDataFrame(turned, TABLES["labels"]).write.parquet(str(tmp_path / "labels.parquet"))
    key = lambda d: sorted((r["doc_id"], r["score"]) for r in queries.QUERIES["op1_toxicity"](spark, d).collect())
    assert key(str(tmp_path)) == key(tables[0])


def test_op4(tables, run):
    rows = run("op4_minhash")
    bag = lambda t: (lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []))((t or "").encode().split())
    bags = {d[0]: bag(d[1]) for d in tables[1]}
    texts = {d[0]: d[1] or "" for d in tables[1]}
    of = {i: i for i in bags}
    for i in bags:
        for j in bags:
            common = sum((bags[i] & bags[j]).values())
            if i < j and (texts[i] == texts[j] or common and common >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - common)):
                a, b = sorted((of[i], of[j]))
                of = {k: a if x == b else x for k, x in of.items()}
    assert {r["doc_id"]: r["class_id"] for r in rows} == of and len(rows) == len(of)
    assert all(r["is_first"] == (r["doc_id"] == r["class_id"]) for r in rows)


def test_op5(tables, run):
    rows = {r["doc_id"]: r for r in run("op5_decontaminate")}
    assert len(rows) == len(tables[1])
    assert {i: r["item_ids"] for i, r in rows.items() if r["contaminated"]} == {310: [1]}
    assert rows[310]["best_share"] == 1 and all(r["contaminated"] == bool(r["item_ids"]) for r in rows.values())


def test_op6(tables, run):
    rows, docs = run("op6_sharding"), {d[0]: (d[1] or "").encode() for d in tables[1]}
    slots = defaultdict(list)
    for r in rows:
        text = docs[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 16, zlib.crc32(text), "rows", None)
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(40)]
    assert sum(sizes) == len(docs) and max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_op6_places_go_by_content(spark, tables):
    from simforge.llm import sharding

    docs = spark.createDataFrame([(i % 50, "t") for i in range(400)], "doc_id long, text string")
    place = lambda df: sorted(map(tuple, sharding.shard(df, ["doc_id", "text"]).collect()))
    first = place(docs)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert place(docs.repartition(5, F.rand(3))) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_op7(tables, run):
    rows = run("op7_mixing")
    size = {d[0]: len((d[1] or "").encode().split()) for d in tables[1]}
    own, source = Counter(), {d[0]: d[3] for d in tables[1]}
    for i, n in size.items():
        own[source[i]] += n
    names = sorted(own, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    lo, hi = 0.0, 1e9  # the level by bisection
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(2 * own[s], mid * weight[s]) for s in own) < 1.5 * sum(own.values()) else (lo, mid)
    taken = Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == own[s] and r["target"] == pytest.approx(min(2 * own[s], lo * weight[s]), abs=1e-3)
        assert 0 <= r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    longest = {s: max(size[i] for i in size if source[i] == s) for s in own}
    assert all(target - max(1, longest[s]) <= taken[s] <= target + 1e-6 for s, target in {source[r["doc_id"]]: r["target"] for r in rows}.items())
    assert sorted(map(repr, rows)) == sorted(map(repr, run("op7_mixing")))


def test_op8(tables, run):
    rows, texts = {r["doc_id"]: r for r in run("op8_pii")}, {d[0]: d[1] for d in tables[1]}
    assert {i for i, r in rows.items() if r["text"] != texts[i]} == {311} and len(rows) == len(texts)
    r = rows[311]
    assert (r["n_entities"], r["entity_types"]) == (3, "email,person,phone")
    m = re.fullmatch(r"Write to Mr\. (\w+) (\w+), (\S+)@(\S+)\.example or \+1 \((\d{3})\) (\d{3})-(\d{4})\.", r["text"])
    assert m and not {m[1], m[2], m[3], m[4]} & {"Karl", "Moser", "karl", "moser"} and (m[5], m[6], m[7]) != ("212", "555", "0199")
    assert all(not r["n_entities"] and r["entity_types"] == "" for i, r in rows.items() if i != 311) and pii.GROW > 0


def test_op9(tables, run):
    rows = run("op9_lm")
    split = lambda t: [*(t or "").encode().lower().split(), None]
    held = {d[0]: zlib.crc32(str(d[0]).encode()) % 10 == 0 for d in tables[1]}
    counts = Counter(x for d in tables[1] if not held[d[0]] for x in split(d[1]))
    for r, text in ((r, {d[0]: d[1] for d in tables[1]}[r["doc_id"]]) for r in rows):
        w = split(text)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(w), sum(counts[x] > 0 for x in w), sum(counts.values()))
        assert r["score"] < 0
    assert len(rows) == len(held)


def test_op10(tables, run):
    rows, pages = {r["page_id"]: r for r in run("op10_html")}, {p[0]: p for p in tables[3]}
    for i, r in rows.items():
        html = pages[i][2]
        want = "" if not html else "\n".join([*re.search(r"<h1>(.*)</h1><p>(.*)</p>", html).groups(), "one"]).replace("&amp;", "&")
        assert (r["url"], r["text"], r["n_chars"]) == (pages[i][1], want, len(want))
    assert len(rows) == len(pages)


def test_words_that_polynomials_confuse(spark):
    """Thue-Morse words of 1,024 and 4,096 letters and their complements, which hashes modulo a power of two take for equal."""
    from simforge.llm import lm, minhash, substring

    thue = lambda n, a, b: "".join((a, b)[i.bit_count() & 1] for i in range(n))
    rows = []
    for k, n in enumerate((1024, 4096, 8192)):
        head, tail = [f"h{i}" for i in range(11)], [f"t{i}" for i in range(11)]
        rows += [(2 * k, " ".join([*head, thue(n, "a", "b"), *tail][k:])), (2 * k + 1, " ".join([*head, thue(n, "b", "a"), *tail][k:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in substring.dedup_substrings(docs).collect()}
    assert got == set(substring.brute_force(rows))
    pairs = [(2 * k + j, f"{thue(n, *ab)} x y z w") for k, n in enumerate((1024, 4096)) for j, ab in enumerate(("ab", "ba"))]
    classes = [r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string")).collect()]
    assert len(set(classes)) == 4
    model = lm.fit(spark.createDataFrame([pairs[0]], "doc_id long, text string"))
    (r,) = lm.score(spark.createDataFrame([(9, thue(1024, "b", "a"))], "doc_id long, text string"), model).collect()
    assert (r["n_tokens"], r["n_known"]) == (2, 1)


def test_clashing_names(spark):
    """Columns under the names that the operators use inside."""
    from simforge.llm import mixing, sharding

    docs = spark.createDataFrame([(i, f"t{i}", "s", 5, 1, 2, 3) for i in range(20)], "doc_id long, text string, source string, size long, base int, more int, p_length int")
    assert mixing.mix(docs, "source", "size", ["doc_id"]).columns == [*docs.columns, "source_size", "target", "copies"]
    assert mixing.mix(docs, "source", "size", ["doc_id"]).count() == 20
    docs = spark.createDataFrame([(i, 1, 2, 3, 4) for i in range(20)], "doc_id long, cut_points int, slot int, cell int, block int")
    got = sharding.shard(docs, ["doc_id"])
    assert got.columns == [*docs.columns, "shard", "_slot"] and got.agg(F.countDistinct("shard")).first()[0] == 20


def test_large_draws_match_small_ones():
    """The draw's law at sizes beyond a thousand million, by its mean and deviation; and exactly at small ones."""
    import math

    import numpy as np

    from simforge.llm import sharding

    for good, bad, n in ((5, 9, 6), (40, 100, 30), (1, 1000, 3), (200, 3, 100)):
        low = max(0, n - bad)
        p = np.cumsum([math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(low, min(good, n) + 1)])
        assert all(sharding.hypergeometric(good, bad, n, u) == low + int(np.searchsorted(p, u, side="right")) for u in np.linspace(0.001, 0.999, 301).tolist())
    good, bad, n = 25 * 10**8, 10**11, 2 * 10**6
    draws = np.array([sharding.hypergeometric(good, bad, n, u) for u in (np.arange(2000) + 0.5) / 2000])
    share = good / (good + bad)
    assert abs(draws.mean() - n * share) < 1 and draws.std() == pytest.approx(math.sqrt(n * share * (1 - share)), rel=0.01)
