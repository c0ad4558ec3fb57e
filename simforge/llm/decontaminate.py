"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed terms over all passages of all documents.
2. A randomised singular value decomposition of the TF-IDF matrix of passages: tasks multiply their passages with a common
   test matrix and back, a distributed sum joins the products, and the driver, which holds only terms x dimensions, makes
   the basis (one power iteration, then Rayleigh-Ritz).  It is fitted on all passages; a task sends one product for
   `TASK_PASSAGES` passages or more, and the products are added in two steps, `FAN` in the first.
3. A region of a document counts if its longest common subsequence with an item covers `COVERED` of the item's words, or
   `PARAPHRASE` of them while `ANSWERED` of the answer's words are there (a column of answers, or else the item's rarest
   words).  Such a region has one of the item's key words: of its rarest words one more than may be missing, or of the
   answer's.  Documents whose words allow the share are therefore found by key words and exact word counts, without loss.
4. In these documents every window at lengths near those of the items is compared with the items by the cosine of the
   whitened latent vectors; windows that reach `COSINE` are verified first.  Paraphrases that the rule accepts come down to
   a cosine of 0.1, where half of all windows are, so the cosine decides the order only: unless an item was found whole,
   all regions around its key words are verified as well.

The items are a benchmark, read in blocks of `BLOCK` items, each against all documents; a block's vectors and words are
what each task gets.

Defined results: null and empty texts and items match nothing; repeated items are each reported; items with the same id
and several texts are reported once if one of them matches; a null item id is never reported; repeated rows get the same
result; words are compared without regard to case (A-Z); other columns pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simforge.llm.common import chunks, fresh, table, words_of

TERMS = 1 << 15
PASSAGE = 32
DIMENSIONS = 48
EXTRA = 16
TASK_PASSAGES, FAN = 1 << 16, 32
FREQUENT = 128
COSINE = 0.65
COVERED, PARAPHRASE, ANSWERED = 0.8, 0.6, 0.8
ANSWER_WORDS = 5
BLOCK = 1024
CELL = 4
PARTS = 16
SEED = 1_009
_U = np.uint64


def _words(texts: list[bytes | None]):
    """Hashes and hashed terms of the lower-cased words, and where each text's words begin."""
    _, _, _, words, bounds = words_of([(t or b"").lower() for t in texts])
    return words, (words >> _U(64 - 15)).astype(np.int64), bounds


def _passages(bounds: np.ndarray, width: int) -> np.ndarray:
    """Where each run of width words begins, document by document; a document's last run may be shorter."""
    n = np.diff(bounds)
    count = -(-n // width)
    doc = np.repeat(np.arange(len(n)), count)
    return bounds[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * width


def _parts_of(x: np.ndarray):
    pieces = np.array_split(x, PARTS)
    return pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary())], names=["part", "x"])


def _frequencies(batches):
    total = np.zeros(TERMS + 1, np.int64)  # the last: number of passages
    for t in chunks(batches, "text", 1 << 19):
        words, terms, bounds = _words(t.column("text").to_pylist())
        start = _passages(bounds, PASSAGE)
        if len(start):
            size = np.diff(np.append(start, len(words)))
            for a in range(0, len(start), 1 << 16):  # so that passage and term fit into 32 bits
                b = min(len(start), a + (1 << 16))
                lo, hi = start[a], start[b] if b < len(start) else len(words)
                both = np.repeat(np.arange(b - a, dtype=np.uint32) << np.uint32(15), size[a:b]) | terms[lo:hi].astype(np.uint32)
                both.sort()
                both = both[np.append(True, both[1:] != both[:-1])]
                total[:TERMS] += np.bincount(both & np.uint32(TERMS - 1), minlength=TERMS)
            total[TERMS] += len(start)
    yield _parts_of(total)


def _sum(kind):
    def run(t: pa.Table) -> pa.Table:
        arrays = sorted(t.column("x").to_pylist())  # so that the order of tasks changes no digit
        total = np.zeros(len(arrays[0]) // np.dtype(kind).itemsize, np.float64 if kind == np.float32 else kind)
        for x in arrays:
            total += np.frombuffer(x, kind)
        return pa.table({"part": [t.column("part")[0].as_py()], "x": [total.astype(kind).tobytes()]}, schema=pa.schema([("part", pa.int32()), ("x", pa.binary())]))

    return run


def _total(rows: DataFrame, kind) -> np.ndarray | None:
    rows = rows.withColumn("task", F.floor(F.spark_partition_id() / F.lit(FAN)).cast("int"))
    few = rows.groupBy("part", "task").applyInArrow(_sum(kind), "part int, x binary")
    got = few.groupBy("part").applyInArrow(_sum(kind), "part int, x binary").collect()
    return np.concatenate([np.frombuffer(r["x"], kind) for r in sorted(got, key=lambda r: r["part"])]) if got else None


def _sums(vectors: np.ndarray, terms: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Sums of the terms' vectors over runs of at most width words; vectors has a row of zeros at its end."""
    size = np.diff(np.append(start, len(terms)))
    out = vectors[terms[start]]
    for j in range(1, width):
        out += vectors[np.where(j < size, terms[np.minimum(start + j, len(terms) - 1)], TERMS)]
    return out


def _gram(test: np.ndarray, idf: np.ndarray):
    """The passages' transposed matrix times their matrix times test: the most frequent terms as a dense matrix, the others by sums of columns."""
    k = test.shape[1]

    def run(batches):
        weighted = np.ascontiguousarray((test * idf[:, None]).T.astype(np.float32))
        top = np.argsort(idf, kind="stable")[:FREQUENT]
        rank = np.full(TERMS, FREQUENT)
        rank[top] = np.arange(FREQUENT)
        top_weighted, square = np.ascontiguousarray(weighted[:, top].T), idf * idf
        out, top_out = np.zeros((k, TERMS)), np.zeros((FREQUENT, k))
        some = False
        for t in chunks(batches, "text", 1 << 19):
            words, terms, bounds = _words(t.column("text").to_pylist())
            start = _passages(bounds, PASSAGE)
            for a in range(0, len(start), 1 << 14):
                b = min(len(start), a + (1 << 14))
                some = True
                lo, hi = start[a], start[b] if b < len(start) else len(words)
                term, first = terms[lo:hi], start[a:b] - lo
                passage = np.repeat(np.arange(b - a), np.diff(np.append(first, hi - lo)))
                r = rank[term]
                is_top = r < FREQUENT
                dense = np.bincount(passage[is_top] * FREQUENT + r[is_top], minlength=(b - a) * FREQUENT).reshape(b - a, FREQUENT).astype(np.float32)
                z = dense @ top_weighted
                term, of = term[~is_top], passage[~is_top]
                if len(term):
                    runs = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                    z[of[runs]] += np.add.reduceat(weighted.take(term, axis=1), runs, axis=1).T
                z /= (np.add.reduceat(square[terms[lo:hi]], first) + 1e-9).astype(np.float32)[:, None]
                top_out += dense.T @ z
                if len(term):
                    columns = np.ascontiguousarray(z.T, np.float64)
                    for j in range(k):
                        out[j] += np.bincount(term, columns[j].take(of), TERMS)
        if some:
            out = out.T
            out[top] += top_out
            yield _parts_of((out * idf[:, None]).astype(np.float32).reshape(-1))

    return run


def fit(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Whitened term vectors (terms x dimensions, idf included) and idf."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    counted = _total(texts.mapInArrow(_frequencies, "part int, x binary"), np.int64)
    n = int(counted[TERMS]) if counted is not None else 0
    if not n:
        return np.zeros((TERMS, DIMENSIONS), np.float32), np.ones(TERMS)
    idf = np.log((n + 1) / (counted[:TERMS] + 1)) + 1
    texts = texts.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_PASSAGES)))  # each task sends a whole product
    q = np.random.default_rng(SEED).standard_normal((TERMS, DIMENSIONS + EXTRA)).astype(np.float32)
    for _ in range(2):
        y = _total(texts.mapInArrow(_gram(q, idf), "part int, x binary"), np.float32).reshape(TERMS, -1).astype(np.float64)
        small = q.T.astype(np.float64) @ y
        basis = q
        q = np.linalg.qr(y)[0].astype(np.float32)
    # basis is orthonormal in the last round: small holds the passages' second moments in it
    value, vector = np.linalg.eigh((small + small.T) / 2)
    value, vector = value[::-1][:DIMENSIONS], vector[:, ::-1][:, :DIMENSIONS]
    good = value > max(value[0], 0) * 1e-9
    vectors = (basis.astype(np.float64) @ vector) * np.where(good, 1 / np.sqrt(np.maximum(value, 1e-30)), 0)
    return (vectors * idf[:, None]).astype(np.float32), idf


def common_length(item: dict[int, int], n: int, window: np.ndarray) -> int:
    """Longest common subsequence, bit by bit: item has for each word the bits of its places among n."""
    full = (1 << n) - 1
    v = full
    for w in window.tolist():
        if m := item.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _least(share: float, n: int) -> int:
    """The least number of n that is at least this share of them."""
    return math.ceil(share * n - 1e-9)


class Item:
    """What is needed of an item to verify a region."""

    def __init__(self, item_id: int, words: np.ndarray, answer: np.ndarray | None, idf: np.ndarray):
        self.id, self.n = item_id, len(words)
        self.bits: dict[int, int] = {}
        for i, w in enumerate(words.tolist()):
            self.bits[w] = self.bits.get(w, 0) | 1 << i
        rare = lambda x: x[np.argsort(-idf[(x >> _U(49)).astype(np.int64)], kind="stable")]
        answer = rare(np.unique(words))[:ANSWER_WORDS] if answer is None or not len(answer) else rare(np.unique(answer))
        self.answer = set(answer.tolist())
        self.answered = _least(ANSWERED, len(answer))
        self.covered, self.paraphrase = _least(COVERED, self.n), _least(PARAPHRASE, self.n)
        self.region = self.n + 2 * max(2 * CELL, self.n // 2)
        # a region that counts lacks too few of these words to lack all of them
        self.key = np.unique(np.concatenate([rare(words)[: self.n - self.covered + 1], answer[: len(answer) - self.answered + 1]]))
        self.words = np.unique(np.concatenate([words, answer]))
        self.times = np.array([self.bits.get(w, 0).bit_count() for w in self.words.tolist()])
        self.is_answer = np.isin(self.words, answer)

    def possible(self, times: int, answers: int) -> bool:
        """Whether a region can count that has so many of the item's words and so many of the answer's."""
        return times >= self.covered or times >= self.paraphrase and answers >= self.answered

    def share(self, region: np.ndarray) -> float:
        """The part of the item that is in the region, or 0 if it doesn't count."""
        there = set(region.tolist())
        answers = len(self.answer & there)
        if not self.possible(sum(b.bit_count() for w, b in self.bits.items() if w in there), answers):
            return 0.0
        common = common_length(self.bits, self.n, region)
        return common / self.n if self.possible(common, answers) else 0.0

    def best(self, words: np.ndarray, hits: np.ndarray, keys: np.ndarray) -> float:
        """The largest share of all regions of a document; hits: places of the item's and the answer's words; keys: of its key words."""
        # a region may as well begin at a hit, and has a key word
        at = np.searchsorted(keys, hits)
        starts = hits[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] < hits + self.region)]
        ends = np.searchsorted(hits, starts + self.region)
        best, matched = 0.0, words[hits]
        for a, b in zip(np.searchsorted(hits, starts).tolist(), ends.tolist()):
            if b - a >= max(self.paraphrase, best * self.n) and (share := self.share(matched[a:b])) > best:
                best = share
                if best >= 1:
                    break
        return best


class Index:
    """The items' words, and which items have which key word."""

    def __init__(self, items: list[Item]):
        self.items = items
        self.words = np.unique(np.concatenate([i.words for i in items]))
        self.own = [np.searchsorted(self.words, i.words) for i in items]
        pairs = np.array([(k, c) for c, i in enumerate(items) for k in np.searchsorted(self.words, i.key).tolist()])
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        self.item = pairs[:, 1]
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(self.words) + 1))

    def places(self, words: np.ndarray) -> np.ndarray:
        """Number of each word among the items' words; one past the last for others."""
        at = np.searchsorted(self.words, words)
        return np.where(self.words[np.minimum(at, len(self.words) - 1)] == words, at, len(self.words))

    def possible(self, number: np.ndarray, bounds: np.ndarray):
        """(document, [(item, hits, keys)]) for all documents and items whose words allow that a region counts."""
        at = np.flatnonzero(number < len(self.words))
        at = at[self.first[number[at] + 1] > self.first[number[at]]]
        if not len(at):
            return
        docs = np.searchsorted(bounds, at, side="right") - 1
        has = np.zeros(len(self.words) + 1, bool)
        for d, a, b in zip(*(x.tolist() for x in _runs(docs))):
            lo, hi = int(bounds[d]), int(bounds[d + 1])
            own, keys = number[lo:hi], at[a:b]
            size = self.first[number[keys] + 1] - self.first[number[keys]]
            items = self.item[np.repeat(self.first[number[keys]], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
            has[own] = True
            out = []
            for c in np.unique(items).tolist():
                item, there = self.items[c], has[self.own[c]]
                if item.possible(int(item.times[there].sum()), int((there & item.is_answer).sum())):
                    mine = np.zeros(len(self.words) + 1, bool)
                    mine[self.own[c]] = True
                    out.append((c, np.flatnonzero(mine[own]), np.repeat(keys, size)[items == c] - lo))
            has[own] = False
            if out:
                yield d, out


def _runs(x: np.ndarray):
    """Value, start and end of each run of equal values."""
    start = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    return x[start], start, np.append(start[1:], len(x))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.sqrt((x * x).sum(axis=1, keepdims=True)) + 1e-12)


def _lengths(longest: int) -> np.ndarray:
    """Window lengths in whole cells: up to three, then each two fifths longer than the one before."""
    out = [CELL, 2 * CELL, 3 * CELL]
    while out[-1] < longest:
        out.append(-(-int(out[-1] * 1.4) // CELL) * CELL)
    return np.array(out)


def _search(items: list[Item], vectors: np.ndarray, terms: np.ndarray):
    """vectors: latent ones of the items; terms: of the terms."""
    terms = np.vstack([terms, np.zeros((1, terms.shape[1]), np.float32)])
    latent, index = _unit(vectors), Index(items)
    lengths = _lengths(max(i.n for i in items))
    of = np.argmin(np.abs(lengths[None] - np.array([i.n for i in items])[:, None]), axis=1)

    def near(term: np.ndarray, chosen: np.ndarray):
        """(first word, item) of the document's windows that are near one of the chosen items."""
        start = np.arange(0, len(term), CELL)
        total = np.zeros((len(start) + 1, terms.shape[1]), np.float32)
        np.cumsum(_sums(terms, term, start, CELL), axis=0, out=total[1:])
        for scale in np.unique(of[chosen]):
            some = chosen[of[chosen] == scale]
            cells = int(lengths[scale]) // CELL
            at = np.arange(0, len(start), max(1, cells // 4))
            x = total[np.minimum(at + cells, len(start))] - total[at]
            row, col = np.nonzero(_unit(x) @ latent[some].T >= COSINE)
            yield from zip(start[at[row]].tolist(), some[col].tolist())

    def run(batches):
        for t in chunks(batches, "text", 1 << 18):
            words, term, bounds = _words(t.column("text").to_pylist())
            found: list[dict[int, float]] = [{} for _ in range(t.num_rows)]
            for d, open_ in index.possible(index.places(words), bounds):
                lo, hi = int(bounds[d]), int(bounds[d + 1])
                own = words[lo:hi]
                for first, c in near(term[lo:hi], np.array([c for c, _, _ in open_])):
                    if found[d].get(c, 0) < 1:
                        reach = (items[c].region - items[c].n) // 2
                        if (share := items[c].share(own[max(0, first - reach) : first + items[c].n + reach])) > found[d].get(c, 0):
                            found[d][c] = share
                for c, hits, keys in open_:
                    if found[d].get(c, 0) < 1 and (share := items[c].best(own, hits, keys)) > found[d].get(c, 0):
                        found[d][c] = share
            ids = [sorted({items[c].id for c in f}) for f in found]
            t = t.drop_columns(["text"]).append_column("item_ids", pa.array(ids, pa.list_(pa.int64()))).append_column("best_share", pa.array([max(f.values(), default=0.0) for f in found], pa.float64()))
            yield from t.to_batches()

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", answer_col: str | None = None) -> DataFrame:
    """docs with item_ids (sorted; empty if clean) and best_share (the largest part of an item found), under these names or with underscores in front."""
    outs = {c: fresh(docs, c) for c in ("item_ids", "best_share")}
    vectors, idf = fit(docs, text_col)
    ids, share, searched = fresh(docs, "all_item_ids"), fresh(docs, "all_best_share"), docs
    rest = docs.columns
    first = True
    answers = F.col(answer_col) if answer_col else F.lit(None).cast("string")
    rows = benchmark.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"), answers.alias("a")).toLocalIterator()
    block: list[Item] = []
    sums: list[np.ndarray] = []

    def apply(df: DataFrame) -> DataFrame:
        v = np.array(sums, dtype=np.float32)
        have = df.columns
        cols = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(have)]
        kinds = [f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(have)]
        done = df.select(*cols, F.col(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(_search(list(block), v, vectors), ", ".join([*kinds, "item_ids array<long>, best_share double"]))
        new_ids, new_share = (F.col("item_ids"), F.col("best_share")) if first else (F.array_sort(F.array_union(F.col(f"c{have.index(ids)}"), "item_ids")), F.greatest(F.col(f"c{have.index(share)}"), "best_share"))
        return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], new_ids.alias(ids), new_share.alias(share))

    for r in rows:
        words, terms, _ = _words([r["t"].encode()])
        if not len(words):
            continue
        block.append(Item(r["i"], words, _words([r["a"].encode()])[0] if r["a"] else None, idf))
        sums.append(vectors[terms].sum(axis=0))
        if len(block) == BLOCK:
            searched, first = apply(searched), False
            block, sums = [], []
    if block:
        searched, first = apply(searched), False
    if first:
        searched = searched.withColumns({ids: F.array().cast("array<long>"), share: F.lit(0.0)})
    return searched.select(*[F.col(f"`{c}`") for c in rest], F.col(ids).alias(outs["item_ids"]), F.col(share).alias(outs["best_share"]))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = contaminated(docs, table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "best_share")


QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLE: dict[str, str] = {}
