"""Near-duplicate classes by BagMinHash and verified multiset overlap.

A document is the multiset of its runs of `SHINGLE` words (of all words, where it has fewer).  Each shingle has Poisson
processes over the slabs [0,1), [1,2), [2,4), ... of its weight; a point has a time, a signature component and a height in
its slab, all hashed from shingle and slab, and counts where its height is below the shingle's weight.  The earliest time
of a component agrees for two documents with a probability equal to their weighted Jaccard similarity.  Processes are
followed only until all components of a document are filled.

Signatures are cut into bands.  In each bucket of a band the document with the least id is the hub.  Each document is
verified, by the exact multisets, against the hub with which it has most bands in common.  Buckets that still hold several
classes are then searched across classes, in squares of bounded size, by products of sparse incidence matrices; a square
gives links that span what it joins, not all its pairs, and members of one class are not compared again.  So every pair with
a band in common whose similarity is at least `SIMILAR` ends in one class.

Copies of a text are one node from the first exchange on, of which tasks send one row each; rows of a hot node, hub or band
are dealt over `SPREAD` tasks in the joins.

Defined results: a null text counts as empty; equal texts are one class, also those without words, and texts without words
are near no other; class_id is the least doc_id of the class (null ids count last, and are the class_id of a class that
has no other); repeated rows get the same class; an empty table gives no rows; texts of any length are compared whole (a
very long one stands alone in a block); other columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simforge.llm.common import NULL_ID, chunks, cut, fresh, mix, run_hashes, table, words_of

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 20, 4
M = BANDS * ROWS
#: Texts of a bucket that are compared with as many others in one group.
SQUARE = 512
#: Rows of one key are dealt over so many tasks in joins.
SPREAD = 16
#: Up to so many links, one task joins them to components; beyond, stars do, by rounds.
FEW_LINKS = 500_000
_U = np.uint64
_A, _B = _U(0x9E3779B97F4A7C15), _U(0xD1B54A32D192ED03)


def shingles(words: np.ndarray, bounds: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document: document number, hash, weight; in order of document and hash."""
    n = np.diff(bounds)
    size = np.minimum(n, k)
    count = n - size + (n > 0)
    doc = np.repeat(np.arange(len(n)), count)
    start = bounds[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    h = run_hashes(words, start, start + size[doc])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return doc[first], h[first], np.diff(np.append(first, len(h)))


def _unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes."""
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int, m: int = M) -> np.ndarray:
    """n_docs rows of m earliest times; rows of documents without shingles stay infinite."""
    best = np.full((n_docs, m), np.inf)
    # slabs 0: [0,1), k: [2**(k-1), 2**k)
    levels = 1 + np.ceil(np.log2(weight)).astype(np.int64)
    entry = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(entry)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 2.0 ** (level - 1.0), 0.0)
    width = np.where(level > 0, low, 1.0)
    d, w = doc[entry], weight[entry].astype(np.float64)
    seed = mix(shingle[entry] + level.astype(np.uint64) * _A)
    total = np.bincount(doc, weight, n_docs)
    limit = m * (np.log(m) + 5) / np.maximum(total, 1)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        live = np.flatnonzero(np.isin(d, todo)) if len(todo) < n_docs else np.arange(len(d))
        time, step = np.zeros(len(live)), 0
        while len(live):
            step += 1
            x = mix(seed[live] + _U(step * int(_B) % 2**64))
            time = time - np.log(_unit(x)) / width[live]
            on = time < limit[d[live]]
            live, time, x = live[on], time[on], x[on]
            y = mix(x ^ _A)
            counts = low[live] + width[live] * _unit(y) < w[live]
            at = d[live] * m + (mix(y ^ _B) % _U(m)).astype(np.int64)
            np.minimum.at(best.reshape(-1), at[counts], time[counts])
        todo = todo[np.isinf(best[todo]).any(axis=1)]
        best[todo] = np.inf
        limit[todo] *= 2
    return best


def _sign(batches):
    for t in chunks(batches, "text", 1 << 19):
        _, _, _, words, bounds = words_of(t.column("text").to_pylist())
        doc, h, w = shingles(words, bounds)
        sig = signatures(doc, h, w, t.num_rows).view(np.uint64)
        n = np.bincount(doc, w, t.num_rows).astype(np.int64)
        keys = np.zeros((t.num_rows, BANDS), np.uint64)
        for i in range(ROWS):
            keys = mix(keys * _A + mix(sig[:, i::ROWS] + _U(i + 1)))
        keys += mix(np.arange(1, BANDS + 1, dtype=np.uint64))[None]
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (t.num_rows + 1) * BANDS, BANDS), pa.int32()), pa.array(keys.view(np.int64).reshape(-1)))
        yield pa.RecordBatch.from_arrays([t.column("id").combine_chunks(), t.column("node").combine_chunks(), pa.array(n), bands], names=["id", "node", "n", "bands"])


def overlap(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of the shingles of two texts."""
    _, _, _, words, bounds = words_of([a, b])
    doc, h, w = shingles(words, bounds)
    if not len(h) or bounds[1] == 0 or bounds[1] == bounds[2]:
        return 0.0
    cut_at = np.searchsorted(doc, 1)
    common, i, j = np.intersect1d(h[:cut_at], h[cut_at:], assume_unique=True, return_indices=True)
    shared = np.minimum(w[:cut_at][i], w[cut_at:][j]).sum()
    return float(shared / (w.sum() - shared))


def _verify(batches):
    for batch in batches:
        keep = [overlap(a, b) >= SIMILAR for a, b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist())]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _forest(a, b) -> dict:
    """The root of each end of some links; the root is the least of its component."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(a, b):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(up)}


def _few(batches):
    a, b = [], []
    for batch in batches:
        a += batch.column("u").to_pylist()
        b += batch.column("v").to_pylist()
    of = _forest(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(of.keys(), pa.binary()), pa.array(of.values(), pa.binary())], names=["node", "root"])


def components(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """(node, root) of all ends of links (a, b); root is the least node of the component.

    A number of links up to few goes to one task.  More are replaced, large stars and small stars by turns, by links to a
    smaller neighbour, until all link to roots.
    """
    e = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    if e.count() <= few:
        return e.coalesce(1).mapInArrow(_few, "node binary, root binary")
    mark = None
    while True:
        for small in (False, True):
            ends = e if small else e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = ends.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
            near = ends.join(least, F.col("u") == F.col("k"))
            if small:
                e = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
            else:
                e = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.where("u != m").select("u", F.col("m").alias("v")))
            e = e.where("u != v").distinct()
        e = cut(e)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _across(t: pa.Table) -> pa.Table:
    """Links that join classes of a square: overlaps of all its texts by products of incidence matrices, some columns at a time."""
    node, side = t.column("node").to_pylist(), t.column("side").to_numpy()
    root = np.unique(np.array(t.column("root").to_pylist(), dtype=object), return_inverse=True)[1]
    lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
    _, _, _, words, bounds = words_of(t.column("text").to_pylist())
    doc, h, w = shingles(words, bounds)
    total = np.bincount(doc, w, len(node))
    # a column for each shingle and copy of it; columns of one text alone don't matter
    entry = np.repeat(np.arange(len(h)), w)
    unit = mix(h[entry] + (np.arange(len(entry)) - np.repeat(np.cumsum(w) - w, w)).astype(np.uint64) * _A)
    _, column, count = np.unique(unit, return_inverse=True, return_counts=True)
    keep = np.flatnonzero(count[column] > 1)
    column, d = np.unique(column[keep], return_inverse=True)[1], doc[entry[keep]]
    order = np.argsort(column, kind="stable")
    column, d = column[order], d[order]
    left, right = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
    common = np.zeros((len(left), len(right)), np.float32)
    place = np.zeros(len(node), np.int64)
    place[right] = np.arange(len(right))
    row = np.zeros(len(node), np.int64)
    row[left] = np.arange(len(left))
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        a, b = np.searchsorted(column, [c, c + 2048])
        x, y = np.zeros((len(left), 2048), np.float32), np.zeros((len(right), 2048), np.float32)
        i, k = d[a:b], column[a:b] - c
        l, r = side[i] == lo, side[i] == hi
        x[row[i[l]], k[l]] = 1
        y[place[i[r]], k[r]] = 1
        common += x @ y.T
    similar = (common >= SIMILAR * (total[left][:, None] + total[right][None] - common)) & (root[left][:, None] != root[right][None])
    i, j = np.nonzero(similar)
    a, b, up = [], [], {}
    for x, y in zip(left[i].tolist(), right[j].tolist()):
        p, q = int(root[x]), int(root[y])
        while p in up:
            p = up[p]
        while q in up:
            q = up[q]
        if p != q:
            up[max(p, q)] = min(p, q)
            a.append(node[x])
            b.append(node[y])
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def spread(left: DataFrame, right: DataFrame, key: str, by: Column, how: str = "inner") -> DataFrame:
    """left.join(right, key) with left's rows of one key dealt over SPREAD tasks by a hash of by.

    A key's row of right goes only to those tasks that have rows of left for it, of which tasks tell each other once.
    """
    part = fresh(left, "spread_part")
    left = left.withColumn(part, F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int"))
    there = left.select(key, part).distinct()
    return left.join(there.join(right, key), [key, part], how).drop(part)


def _sides(inside: DataFrame) -> DataFrame:
    """(band, lo, hi, side, node, root): the squares in which what is left of buckets (band, node, root) is compared.

    Classes of more than SQUARE texts in a bucket have sides of their own, smaller ones share sides; two sides make a square
    unless both are of one class, so that members of a class are not compared with one another.
    """
    classes = cut(inside.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n")))
    pools = classes.groupBy("band").agg(F.ceil(F.sum(F.when(F.col("n") <= SQUARE, F.col("n")).otherwise(0)) / SQUARE).cast("int").alias("n_pools"))
    classes = classes.join(pools, "band").withColumn("n_sides", F.ceil(F.col("n") / SQUARE).cast("int"))
    large = F.col("n") > SQUARE
    sides = classes.select("band", F.when(large, F.col("root")).alias("own"), F.explode(F.when(large, F.sequence(F.lit(0), F.col("n_sides") - 1)).otherwise(F.array(F.pmod(F.xxhash64("root"), F.col("n_pools")).cast("int")))).alias("k")).distinct()
    named = sides.select("band", "own", F.xxhash64("own", "k").alias("side"))
    other = named.select(F.col("band").alias("band2"), F.col("own").alias("own2"), F.col("side").alias("side2"))
    squares = named.join(other, (F.col("band") == F.col("band2")) & (F.col("side") <= F.col("side2")) & (F.col("own").isNull() | F.col("own2").isNull() | (F.col("own") != F.col("own2"))))
    squares = squares.select("band", F.col("side").alias("lo"), F.col("side2").alias("hi"))
    ends = squares.select("band", F.col("lo").alias("side"), "lo", "hi").union(squares.where("lo != hi").select("band", F.col("hi").alias("side"), "lo", "hi"))
    sizes = classes.select("band", "root", "n", "n_sides", "n_pools")
    at = F.when(large, F.xxhash64("root", F.pmod(F.xxhash64("node"), F.col("n_sides")).cast("int"))).otherwise(F.xxhash64(F.lit(None).cast("binary"), F.pmod(F.xxhash64("root"), F.col("n_pools")).cast("int")))
    placed = inside.join(sizes, ["band", "root"]).select("band", "node", "root", at.alias("side"))
    return placed.join(ends, ["band", "side"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with class_id and is_first (the row may stay: it is of the class's first text by id and hash, and, of rows equal in both, each)."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    node, key_id = F.unhex(F.md5(text)), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    keyed = docs.select(key_id.alias("id"), node.alias("node"), text.alias("text"))
    signed = keyed.mapInArrow(_sign, "id long, node binary, n long, bands array<long>")
    nodes = cut(signed.groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    members = nodes.where("n > 0").select(F.explode("bands").alias("band"), "id", "node")
    hubs = members.groupBy("band").agg(F.min(F.struct("id", "node")).alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    spokes = cut(spread(members, hubs, "band", F.col("node")).select("band", "id", "node", F.col("hub.id").alias("hub_id"), F.col("hub.node").alias("hub")))
    # one row of each text that has company: copies lie apart, as their ids differ
    texts = cut(keyed.join(spokes.select("node", "id").distinct(), ["node", "id"], "left_semi").groupBy("node").agg(F.first("text").alias("text")))
    # each node with the hub it meets most often
    met = spokes.where("node != hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("bands"), F.first("hub_id").alias("hub_id"))
    pairs = met.groupBy("node").agg(F.min(F.struct(-F.col("bands"), "hub_id", "hub")).alias("h")).select(F.col("h.hub").alias("a"), F.col("node").alias("b"))
    with_hub = spread(pairs, texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a", F.col("b"))
    both = with_hub.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    links = cut(both.mapInArrow(_verify, "a binary, b binary"))
    root = cut(components(links))

    def rooted(df: DataFrame) -> DataFrame:
        ends = root.select(F.col("node").alias("root_of"), F.col("root").alias("its_root"))
        return df.join(ends, F.col("node") == F.col("root_of"), "left").withColumn("root", F.coalesce("its_root", "node")).drop("root_of", "its_root")

    # what is left between classes of a bucket
    inside = cut(rooted(spokes.select("band", "node")))
    mixed = inside.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("band")
    squares = _sides(spread(inside, mixed, "band", F.col("node")))
    more = cut(squares.join(texts, "node").select("band", "lo", "hi", "side", "node", "root", "text").groupBy("band", "lo", "hi").applyInArrow(_across, "a binary, b binary"))
    if not more.isEmpty():
        root = cut(components(links.union(more)))
    classed = rooted(nodes.select("id", "node"))
    leads = classed.groupBy("root").agg(F.min(F.struct("id", "node")).alias("lead"))
    n, i, of_class, is_lead = (fresh(docs, x) for x in ("near_node", "near_id", "near_class", "near_lead"))
    lead = (F.col("lead.node") == F.col("node")) & (F.col("lead.id") == F.col("id"))
    classes = spread(classed, leads, "root", F.col("node")).select(F.col("node").alias(n), F.col("lead.id").alias(of_class), lead.alias(is_lead))
    outs = {c: fresh(docs, c) for c in ("class_id", "is_first")}
    done = spread(docs.withColumns({n: node, i: key_id}), classes, n, F.col(i))
    lead = F.col(is_lead) & (F.col(i) == F.col(of_class))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns], F.when(F.col(of_class) != NULL_ID, F.col(of_class)).alias(outs["class_id"]), lead.alias(outs["is_first"]))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "is_first")


QUERIES = {"op4_minhash": op4_minhash}
ORACLE: dict[str, str] = {}
