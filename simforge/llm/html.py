"""Main text of web pages as a maximum-scoring subsequence of words and tags.

A page is read as a sequence of tags and pieces of text.  A word scores positive where words under the same elements are
content in the labelled pages, and tags score negative, the more the less they occur inside content.  One linear scan
finds the contiguous stretch with the highest sum; inside it, words under boilerplate elements are left out, at no cost to
the stretch where content surrounds them.

Labelled pages are those that mark their content with exactly one article element or, without one, with exactly one main,
role=main or itemprop=articleBody.  Weights are log odds, counted over at most `max_pages` labelled pages (a bounded sample,
as a parameter: those with the least hash of their html).  What is weighed are elements that say something of their role
(sectioning elements, and those with a class, id or role), alone and together with the next such element around them; tags
together with the element of that kind they stand in.  Elements without counts get priors: a class name that names
boilerplate is such a prior, and inside content a header or an element that is boilerplate elsewhere is content.

Defined results: null or empty html and pages without a word give the empty text; unclosed elements end with their parent,
and nesting may be of any depth; comments, scripts and styles that are not closed run to the end; character references are
decoded once, piece by piece, never across a tag; very long pages are read whole in one linear pass; of stretches with the
same sum the first holds; repeated rows are each extracted; without labelled pages the priors alone decide; an empty table
gives no rows; other columns pass through, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simforge.llm.common import fresh, table

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>?""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_RAW = {n: re.compile(rf"</{n}[\s/>]", re.I) for n in ("script", "style", "template", "textarea", "title", "svg", "iframe", "select")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rt rp s samp small span strike strong sub sup time tt u var wbr br img".split())
#: Elements that end an open element of the key's kind, and what bounds the search for one.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_LISTS = frozenset("ul ol dl table select".split())
_P_ENDS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SECTIONS = frozenset("article main section nav header footer aside form button menu dialog input head".split())
_JUNK = frozenset("nav footer aside form button menu dialog input head".split())
_JUNK_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
_JUNK_WORD = r"ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|masthead|menu|modal|nav\w*|newsletter|notices?|pager|pagination|popup|promo\w*|related|recommend\w*|repl(?:y|ies)|respond|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget"
#: A class or id of boilerplate: one of the words, alone or with words that say no more than that something stands there.
_JUNK_NAME = re.compile(rf"^(?:(?:site|page|post|main|top|bottom|left|right|global|user|reader|social|js)[_-])*(?:{_JUNK_WORD})(?:[_-](?:area|bar|block|body|box|buttons?|container|content|form|holder|icons?|inner|item|left|right|links?|list|main|panel|posts?|articles|section|slot|thread|unit|wrap|wrapper|text|title|\d+|{_JUNK_WORD}))*$", re.I)
_TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table tbody thead tfoot tr td th caption blockquote pre hr figure figcaption math".split())
PRIOR = {"word": 1.0, "content": 2.0, "junk": -2.0, "link": -0.3, "text tag": -0.05, "tag": -0.4, "junk tag": -0.6}
#: What a word under boilerplate, with no content around it, costs a stretch that spans it.
DROPPED = -0.3
MAX_PAGES = 4_000
MOST_KEYS = 4_096


class Node:
    """An open element: its tag, what names its role (or none), whether it marks content, whether its name is boilerplate's, and the next element around it that has a role."""

    __slots__ = ("parent", "tag", "key", "mark", "junk", "around", "value")

    def __init__(self, parent, tag, key, mark, junk):
        self.parent, self.tag, self.key, self.mark, self.junk, self.value = parent, tag, key, mark, junk, None
        self.around = parent if parent is None or parent.key else parent.around

    @property
    def role(self):
        """The innermost element with a role, itself or one around it."""
        return self if self.key else self.around


def _named(tag: str, attrs: str) -> tuple[str | None, str | None, bool]:
    """The element's role (tag, role, and classes or id without digits; none for plain elements); "article" or "main" where it marks content; whether its names are boilerplate's."""
    parts, mark, junk = [], tag if tag in ("article", "main") else None, tag in _JUNK
    if attrs:
        for a, x, y, z in _ATTR.findall(attrs):
            a, value = a.lower(), (x or y or z).lower()
            if a == "itemprop":
                mark = mark or ("main" if value == "articlebody" else None)
                continue
            if a == "role":
                mark = mark or ("main" if value == "main" else None)
                junk = junk or value in _JUNK_ROLES
            elif a == "hidden" or a == "aria-hidden":
                if a == "aria-hidden" and value != "true":
                    continue
                junk, value = True, "hidden"
            elif not mark:
                junk = junk or any(_JUNK_NAME.match(w) for w in value.split())
            if value:
                parts.append(re.sub(r"\d+", "0", value)[:60])
    key = ".".join([tag, *parts]) if parts or mark or tag in _SECTIONS else None
    return key, mark, junk and not mark


def pieces(html: str):
    """The page as (kind, node, value): "text" and "link" with a piece of text (link: inside an a element), "open" and "close" with a tag, "inline" with a tag.

    node is the innermost open element, None outside all.  Inline elements are no nodes.
    """
    node, links = None, 0
    count: Counter = Counter()
    at, n = 0, len(html)

    def leave(node, tag):
        while True:
            count[node.tag] -= 1
            found, node = node.tag == tag, node.parent
            if found:
                return node

    while at < n:
        cut = html.find("<", at)
        m = _TAG.match(html, cut) if cut >= 0 else None
        while cut >= 0 and m is None:  # a lone "<" is text
            cut = html.find("<", cut + 1)
            m = _TAG.match(html, cut) if cut >= 0 else None
        end = cut if cut >= 0 else n
        if end > at:
            yield "link" if links else "text", node, html[at:end]
        if cut < 0:
            return
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in _INLINE:
            if name == "a":
                links = max(0, links + (-1 if m[1] else 1))
            yield ("text", node, " ") if name == "br" else ("inline", node, name)
            continue
        if m[1]:
            yield "close", node, name
            if count[name]:
                node, links = leave(node, name), 0
            continue
        if name in _P_ENDS:
            links = 0
            if node is not None and node.tag == "p":
                node = leave(node, "p")
        if name in _ENDS and any(count[x] for x in _ENDS[name]):
            up = node
            while up is not None and up.tag not in _ENDS[name] and up.tag not in _LISTS:
                up = up.parent
            if up is not None and up.tag in _ENDS[name]:
                while node is not up.parent:
                    count[node.tag] -= 1
                    node = node.parent
                if name == "tr" and node is not None and node.tag == "tr":
                    node = leave(node, "tr")
        inner = Node(node, name, *_named(name, m[3]))
        if name == "form" and (node is None or node.tag in ("html", "body")):
            inner.junk = False  # a form around a whole page
        yield "open", inner, name
        if name in _RAW:
            close = _RAW[name].search(html, at)
            at = close.start() if close else n
            if close:
                at = (html.find(">", at) + 1) or n
        elif name not in _VOID and not (m[3] or "").endswith("/"):
            node = inner
            count[name] += 1


def _path(node: Node | None) -> str:
    """A role together with the one around it."""
    return f"{node.around.key if node.around else ''}>{node.key}"


def count(html: str | None) -> Counter | None:
    """For a labelled page: how often words of each role, alone and with the one around it, and tags in each role are inside and outside the content."""
    html = html or ""
    marks: Counter = Counter(node.mark for kind, node, _ in pieces(html) if kind == "open" and node.mark)
    which = "article" if marks["article"] == 1 else "main" if not marks["article"] and marks["main"] == 1 else None
    if which is None:
        return None
    out: Counter = Counter()
    state: dict[int, tuple] = {}
    kept = []  # nodes stay alive, so that their ids are their own

    def of(node) -> tuple[bool, bool, tuple]:
        """Inside the content; under boilerplate; the roles around."""
        todo = []
        while node is not None and id(node) not in state:
            todo.append(node)
            node = node.parent
        main, junk, roles = state[id(node)] if node is not None else (False, False, None)
        for x in reversed(todo):
            main, junk = main or x.mark == which, junk or x.junk
            roles = (x, roles) if x.key else roles
            state[id(x)] = main, junk, roles
            kept.append(x)
        return main, junk, roles

    for kind, node, value in pieces(html):
        main, junk, roles = of(node)
        if kind in ("text", "link"):
            n = len(value.split())
            if n:
                inside = main and not junk
                if kind == "link":
                    out["word", "<a>", inside] += n
                while roles:
                    x, roles = roles
                    out["word", x.key, inside] += n
                    out["word", _path(x), inside] += n
        elif kind != "inline":
            role = node.role if node else None
            out["tag", f"{role.key if role else ''}>{kind}:{value}", main] += 1
    return out


def weights_of(counts: list[tuple[str, str, int, int]]) -> dict[str, dict[str, float]]:
    """Log odds from (kind, key, inside, outside)."""
    out: dict[str, dict[str, float]] = {"word": {}, "tag": {}}
    for kind, key, a, b in counts:
        odds = log((a + 0.5) / (b + 0.5))
        out[kind][key] = max(-6.0, min(3.0, odds)) if kind == "word" else max(-2.0, min(PRIOR["text tag"], odds))
    return out


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous stretch with the highest sum; empty if none has a sum above 0."""
    best, total, start, span = 0.0, 0.0, 0, (0, 0)
    for i, w in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += w
        if total > best:
            best, span = total, (start, i + 1)
    return span


def extract(html: str | None, weights: dict[str, dict[str, float]]) -> str:
    """The main text: blocks joined by line feeds."""
    words, tags = weights["word"], weights["tag"]

    def own(node: Node, around: float | None) -> float | None:
        """What the element itself says; around: the score that holds around it."""
        content = around is not None and around > 0
        path, alone = words.get(_path(node)), words.get(node.key)
        if path is not None:
            return path
        if node.junk:
            return PRIOR["junk"]
        if alone is not None:
            return None if content and alone < 0 else alone
        if node.mark:
            return PRIOR["content"]
        return 0.0 if node.tag == "header" and around is None else None

    def value(node: Node | None) -> float | None:
        """A word's score from the elements around it, none if they say nothing: the worst of them."""
        todo = []
        while node is not None and node.value is None:
            todo.append(node)
            node = node.parent
        score = node.value[0] if node is not None else None
        for x in reversed(todo):
            mine = own(x, score) if x.key else None
            score = mine if score is None else score if mine is None else min(score, mine)
            x.value = (score,)
        return score

    link = words.get("<a>", PRIOR["link"])
    seq: list[tuple[float, str | None, bool]] = []
    for kind, node, x in pieces(html or ""):
        if kind in ("text", "link"):
            w = value(node)
            w = PRIOR["word"] if w is None else w
            if w >= 0:
                seq.append(((min(w, link) if kind == "link" and w <= PRIOR["word"] else w) * len(x.split()), x, False))
            else:
                up = node
                while up is not None and value(up) is not None and value(up) < 0:
                    up = up.around
                inside = up is not None and (value(up) or 0) > 0
                seq.append((0.0 if inside else DROPPED * len(x.split()), None if x.strip() else x, False))
        elif kind == "inline":
            seq.append((0.0, None, False))
        else:
            role = node.role if node else None
            known = tags.get(f"{role.key if role else ''}>{kind}:{x}")
            if known is None:
                known = PRIOR["text tag"] if x in _TEXT_TAGS else PRIOR["junk tag"] if x in _JUNK else PRIOR["tag"]
                if role is not None and (value(role) or 0) > 0:
                    known = max(known, PRIOR["text tag"])
            seq.append((known, None, True))
    first, last = best_stretch([w for w, _, _ in seq])
    blocks, block = [], []
    for _, text, ends in seq[first:last]:
        if ends:
            blocks.append("".join(block))
            block = []
        elif text is not None:
            block.append(unescape(text))
    blocks.append("".join(block))
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def _counted(batches):
    for batch in batches:
        total: Counter = Counter()
        for html in batch.column("html").to_pylist():
            total.update(count(html) or {})
        keys = sorted({k[:2] for k in total})
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([total[*k, True] for k in keys], pa.int64()), pa.array([total[*k, False] for k in keys], pa.int64())], names=["kind", "key", "a", "b"])


def learn(pages: DataFrame, html_col: str = "html", max_pages: int = MAX_PAGES) -> dict[str, dict[str, float]]:
    """Weights from labelled pages; the most frequent MOST_KEYS elements of each kind are kept."""
    marked = F.regexp_like(F.col(html_col), F.lit("(?i)<(article|main)[\\s>]|\\brole\\s*=\\s*[\"']?main\\b|\\bitemprop\\s*=\\s*[\"']?articlebody\\b"))
    labelled = pages.where(marked).select(F.col(html_col).alias("html"), F.xxhash64(F.col(html_col)).alias("h"))
    last = labelled.select("h").distinct().orderBy("h").limit(max_pages).agg(F.max("h")).first()[0]  # hashes alone, not pages, meet in one task
    sample = labelled.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.first("html").alias("html")).select("html")
    counts = sample.mapInArrow(_counted, "kind string, key string, a long, b long").groupBy("kind", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    rows = counts.orderBy((F.col("a") + F.col("b")).desc(), "kind", "key").limit(2 * MOST_KEYS).collect()
    return weights_of([tuple(r) for r in rows])


def main_text(pages: DataFrame, weights: dict[str, dict[str, float]], html_col: str = "html", out: str = "main_text") -> DataFrame:
    """pages with a column of main texts, under out or, where pages has that, with underscores in front."""
    out = fresh(pages, out)
    rest = pages.columns
    cols = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]
    at = f"c{next(i for i, c in enumerate(rest) if c.lower() == html_col.lower())}"

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([extract(h, weights) for h in batch.column(at).to_pylist()], pa.string())], names=[*batch.schema.names, "out"])

    kinds = [f"c{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)]
    return pages.select(*cols).mapInArrow(run, ", ".join([*kinds, "out string"])).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], F.col("out").alias(out))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    done = main_text(pages, learn(pages))
    return done.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


QUERIES = {"op10_html": op10_html}
ORACLE: dict[str, str] = {}
