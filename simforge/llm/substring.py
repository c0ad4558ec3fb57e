"""Exact substring deduplication by recompression.

Each document is a sequence of words.  A round first names maximal runs of one symbol, then names pairs whose left symbol
is in one half of the alphabet and whose right symbol is in the other (the halves are drawn by hash, anew in each round).
Names are 64-bit values made from the contents alone, so that all executors give the same name to the same contents and no
shuffle is needed to agree on them.  With each symbol goes its context: the words that fix where the symbol starts and ends.
Equal stretches of words get equal symbols wherever the context lies within the stretch.

1. Each window of `width` words takes as its symbol the least name, hashed together with the words of its context, whose
   context lies inside the window.  Neighbouring
   windows with the same symbol are one entry, which carries the symbol and a hash of all its words.  In the first
   exchange entries meet by symbol.  Windows of an entry whose symbol occurs nowhere else occur once.  Of entries equal as
   a whole the first, by (doc_id, place), stays and the windows of the others go.  Entries that have the symbol in common
   but differ are open, as are windows without a symbol of their own (deep repetitions).
2. Open windows are verified one by one by 128-bit hashes of their words (second exchange): of each hash the first place
   stays, and the words of the others go.

Hashes are keyed and not polynomial, and the two halves of 128 bits go back to two independent hashes of each word's bytes:
among 10**13 windows an error has a probability below 10**-12.  Memory for one document grows with its words (about 200
bytes each); very long texts stand alone in a block, and runs of windows are cut at 2**15.

Both exchanges carry packed arrays.  Of equal entries a task sends the first of its block; the others, already known to go,
travel under a bucket drawn from their place, so that a common passage burdens no one bucket.

Defined results: a null or empty text has no words and keeps the empty text; a null doc_id comes after all others; rows
with the same doc_id and text are one document and get the same result; rows with the same doc_id and another text are
ordered by a hash of the text; a document shorter than the window keeps all words; other columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simforge.llm.common import KEYS, NULL_ID, chunks, cut, fresh, hashes, mix, partitions, run_hashes, table, words_of

WIDTH = 20
ROUNDS = 2
_U = np.uint64
_A, _B, _RUN = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)
_FAR = 1 << 60
#: An entry is a run of windows: gone for certain, open (to be verified window by window), or asking; asking entries may be open in any case.
GONE, OPEN, ASK, ASK_OPEN = 0, 1, 2, 3
_BLOBS = "bucket int, lefts binary, rights binary, doc binary, at binary, n binary, kind binary, ids binary, digests binary"
_BLOB_COLUMNS = [x.split()[0] for x in _BLOBS.split(", ")]


def symbols(words: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names after some rounds, with the first word of each context and the word after its last.

    words: hashes; doc: a number for each word, rising from document to document.  A context that the start or end of the
    document cuts off reaches far beyond, so that it fits into no window.
    """
    name = words
    first = np.arange(len(words), dtype=np.int64)
    after = first + 1
    for r in range(rounds):
        if not len(name):
            break
        # runs of one symbol
        new = np.ones(len(name), dtype=bool)
        same = doc[1:] == doc[:-1]
        new[1:] = (name[1:] != name[:-1]) | ~same
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(name)))
        base = name[start]
        d = doc[start]
        run = np.where(size > 1, mix(base * _RUN + size.astype(np.uint64)), base)
        prior, following = np.full(len(start), -_FAR), np.full(len(start), _FAR)
        near = d[1:] == d[:-1]
        prior[1:][near] = first[start[1:] - 1][near]
        following[:-1][near] = after[start[1:]][near]
        # pairs of a left and a right symbol
        left = (mix(base + _U((r + 1) * int(_B) % 2**64)) >> _U(40)) & _U(1) == 1
        pair = np.zeros(len(start), dtype=bool)
        pair[:-1] = left[:-1] & ~left[1:] & near
        second = np.zeros(len(start), dtype=bool)
        second[1:] = pair[:-1]
        at = np.flatnonzero(pair)
        run[at] = mix(run[at] * _A + mix(run[at + 1] * _B + _U(r + 1)))
        following[at] = following[at + 1]
        keep = ~second
        name, first, after, doc = run[keep], prior[keep], following[keep], d[keep]
    return name, first, after


def least_names(words: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window (a window starts at each word that has width - 1 more in its document): its start, its least name, and whether it has one; then the names that come again within two widths."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.uint64)
    window = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :])
    name, first, after = symbols(words, doc)
    fits = (after - first <= width) & (first >= 0) & (after <= n)
    name, first, after = name[fits], first[fits], after[fits]
    name = mix(name ^ run_hashes(words, first, after))  # short symbols recur by chance; with their contexts they don't
    low = np.searchsorted(first, window)
    high = np.searchsorted(after, window + width, side="right")
    some = high > low
    best = np.zeros(len(window), np.uint64)
    level, span, size = name, 1, np.where(some, high - low, 0)
    while len(level) and (size >= span).any():
        here = (size >= span) & (size < 2 * span)
        best[here] = np.minimum(level[low[here]], level[high[here] - span])
        if len(level) <= span:
            break
        level, span = np.minimum(level[:-span], level[span:]), span * 2
    order = np.argsort(name, kind="stable")
    name, first = name[order], first[order]
    return window, best, some, np.unique(name[1:][(name[1:] == name[:-1]) & (first[1:] - first[:-1] <= 2 * width)])


def pack(buckets: int, left, right, doc, at, n, kind, ids, digests):
    """Entries as one row of packed arrays for each bucket that has some.  Asking entries go by left; the others, which need no hashes, by place."""
    asks = kind >= ASK
    left, right = np.where(asks, left, _U(0)), np.where(asks, right, _U(0))
    by = np.where(asks, left, digests[doc].view(np.uint64) + (at >> 6).astype(np.uint64))
    bucket = (mix(by ^ _RUN) % _U(buckets)).astype(np.int32)
    order = np.lexsort((at, doc, bucket))  # neighbours in a text stay neighbours, which compresses
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    columns = [left, right, None, at.astype(np.uint32), n.astype(np.uint16), kind.astype(np.uint8)]
    rows = []
    for b in np.flatnonzero(np.diff(bounds)):
        i = order[bounds[b] : bounds[b + 1]]
        used, local = np.unique(doc[i], return_inverse=True)
        local_of = local.astype(np.uint16 if len(used) <= 65536 else np.uint32)
        rows.append((int(b), *[local_of.tobytes() if k == 2 else c[i].tobytes() for k, c in enumerate(columns)], ids[used].tobytes(), digests[used].tobytes()))
    types = [pa.int32()] + [pa.binary()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, types)], names=_BLOB_COLUMNS)


def unpack(t: pa.Table):
    """Entries of all rows of a bucket: left, right, id, digest, at, n, kind."""
    get = lambda c, kind: [np.frombuffer(x, dtype=kind) for x in t.column(c).to_pylist()]
    ids, digests = get("ids", np.int64), get("digests", np.int64)
    doc = [np.frombuffer(x, dtype=np.uint16 if len(i) <= 65536 else np.uint32) for x, i in zip(t.column("doc").to_pylist(), ids)]
    flat = lambda c, kind: np.concatenate(get(c, kind))
    return flat("lefts", np.uint64), flat("rights", np.uint64), np.concatenate([i[d] for i, d in zip(ids, doc)]), np.concatenate([g[d] for g, d in zip(digests, doc)]), flat("at", np.uint32), flat("n", np.uint16), flat("kind", np.uint8)


def _by_document(ids, digests, at, n, kind):
    """One row for each document: the runs of windows that go, and those still to be verified."""
    order = np.lexsort((at, digests, ids))
    ids, digests, at, n, kind = ids[order], digests[order], at[order], n[order], kind[order]
    start = np.flatnonzero(_new(ids, digests))
    end = np.append(start[1:], len(ids))

    def runs(which: int):
        return pa.array([np.stack([at[a:b][k], n[a:b].astype(np.uint32)[k]]).tobytes() if (k := kind[a:b] == which).any() else None for a, b in zip(start, end)], pa.binary())

    return pa.Table.from_arrays([pa.array(ids[start]), pa.array(digests[start]), runs(GONE), runs(OPEN)], names=["id", "digest", "gone", "open"])


def _new(*columns) -> np.ndarray:
    """Where a row differs from the one before."""
    out = np.ones(len(columns[0]), dtype=bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _first_places(left, right, ids, digests, at):
    """For the entries in order of (left, right, place): that order; which are first of their hashes; which have the first's place."""
    order = np.lexsort((at, digests, ids, right, left))
    new = _new(left[order], right[order])
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    same = (ids[order] == ids[first]) & (digests[order] == digests[first]) & (at[order] == at[first])
    return order, new, same


def _block(t: pa.Table):
    """Of a block of texts: two independent hashes of each word, where each text's words begin, the words' texts, ids and digests."""
    buf, starts, ends, words, bounds = words_of(t.column("text").to_pylist())
    ids = t.column("id").to_numpy().astype(np.int64, copy=False)
    digests = t.column("digest").to_numpy().astype(np.int64, copy=False)
    return words, hashes(buf, starts, ends, KEYS[1]), bounds, np.repeat(np.arange(len(ids)), np.diff(bounds)), ids, digests


class Common:
    """The entries that come more than once in a block, from block to block of a task, each with its first place so far.

    At most `most` are kept, the most frequent; others are sent by each block, which changes no result.
    """

    def __init__(self, most: int = 1 << 16):
        self.most, self.rows = most, [np.zeros(0, k) for k in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64)]

    def later(self, name, whole, ids, digests, at) -> np.ndarray:
        """Which entries an equal one of an earlier block precedes."""
        key = mix(name ^ mix(whole))
        known = mix(self.rows[0] ^ mix(self.rows[1]))
        if not len(known):
            return np.zeros(len(name), bool)
        i = np.minimum(np.searchsorted(known, key), len(known) - 1)
        equal = (self.rows[0][i] == name) & (self.rows[1][i] == whole)
        before = np.zeros(len(name), bool)
        for mine, first in zip((at, digests, ids), (self.rows[4][i], self.rows[3][i], self.rows[2][i])):
            before = (first < mine) | ((first == mine) & before)
        return equal & before

    def add(self, name, whole, ids, digests, at, times) -> None:
        name, whole, ids, digests, at, times = (np.concatenate([a, b.astype(a.dtype)]) for a, b in zip(self.rows, (name, whole, ids, digests, at, times)))
        order, first, _ = _first_places(name, whole, ids, digests, at)
        start = np.flatnonzero(first)
        total = np.add.reduceat(times[order], start) if len(start) else times
        best = order[start]
        if len(best) > self.most:
            keep = np.sort(np.argsort(-total, kind="stable")[: self.most])
            best, total = best[keep], total[keep]
        rows = [x[best] for x in (name, whole, ids, digests, at)] + [total]
        by = np.argsort(mix(rows[0] ^ mix(rows[1])))
        self.rows = [x[by] for x in rows]


def _send_names(width: int, buckets: int):
    def run(batches):
        common = Common()
        for t in chunks(batches, "text", 4 << 20):
            words, others, bounds, doc, ids, digests = _block(t)
            window, name, some, twice = least_names(words, doc, width)
            if not len(window):
                continue
            # neighbouring windows with the same name are one entry
            new = _new(name, some, doc[window], (window - np.arange(len(window))))
            new[:: 1 << 15] = True
            start = np.flatnonzero(new)
            n = np.diff(np.append(start, len(window)))
            name, some, window = name[start], some[start], window[start]
            whole = run_hashes(others, window, window + n + (width - 1), KEYS[1])
            d = doc[window]
            at = window - bounds[d]
            order, first, same = _first_places(name, whole, ids[d], digests[d], at)
            kind = np.empty(len(name), dtype=np.uint8)
            kind[order] = np.where(first, ASK, GONE)
            kind[(kind == ASK) & np.isin(name, twice)] = ASK_OPEN
            kind[~some] = OPEN
            # what comes again from block to block is asked once for each task, or for each place that is the first so far
            places = (name, whole, ids[d], digests[d], at)
            kind[(kind >= ASK) & common.later(*places)] = GONE
            times = np.diff(np.append(np.flatnonzero(first), len(order)))
            again = order[first][times > 1]
            again, times = again[some[again]], times[times > 1][some[again]]
            common.add(*(x[again] for x in places), times)
            keep = np.ones(len(name), dtype=bool)
            keep[order] = first | ~same | ~some[order]
            yield pack(buckets, name[keep], whole[keep], d[keep], at[keep], n[keep], kind[keep], ids, digests)

    return run


def _settle_names(t: pa.Table) -> pa.Table:
    """Of entries equal as a whole the first stays, and is open if there are others of its name; the later ones go."""
    name, whole, ids, digests, at, n, kind = unpack(t)
    asked = np.flatnonzero(kind >= ASK)
    order, first, same = _first_places(name[asked], whole[asked], ids[asked], digests[asked], at[asked])
    order = asked[order]
    _, back, distinct = np.unique(name[order][first], return_inverse=True, return_counts=True)
    out = kind.copy()
    out[order] = np.where(first | same, 255, GONE)
    heads = order[first]
    out[heads[(distinct[back] > 1) | (kind[heads] == ASK_OPEN)]] = OPEN
    keep = out != 255
    return _by_document(ids[keep], digests[keep], at[keep], n[keep], out[keep])


def _runs(packed: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    both = [np.frombuffer(x, dtype=np.uint32).reshape(2, -1).astype(np.int64) for x in packed if x]
    return (np.concatenate([x[0] for x in both]), np.concatenate([x[1] for x in both])) if both else (np.zeros(0, np.int64),) * 2


def _each(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All windows of some runs."""
    return np.unique(np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))


def _joined(ids, digests, doc, at):
    """Windows in order of (doc, at) as runs of neighbours of at most 2**15: doc, at, n."""
    new = _new(doc, at - np.arange(len(at)))
    new[:: 1 << 15] = True
    start = np.flatnonzero(new)
    return doc[start], at[start], np.diff(np.append(start, len(at)))


def _send_windows(width: int, buckets: int):
    def run(batches):
        for t in chunks(batches, "text", 4 << 20):
            words, others, bounds, doc, ids, digests = _block(t)
            window = np.concatenate([_each(*_runs(p)) + bounds[i] for i, p in enumerate(t.column("open").to_pylist())])
            left, right = (run_hashes(w, window, window + width, k) for w, k in zip((words, others), KEYS))
            d = doc[window]
            at = window - bounds[d]
            order, first, same = _first_places(left, right, ids[d], digests[d], at)
            asks = np.sort(order[first])
            later = np.sort(order[~same])
            gone = [_joined(ids, digests, d[later], at[later])]
            for i, p in enumerate(t.column("gone").to_pylist()):
                a, n = _runs(p)
                gone.append((np.full(len(a), i), a, n))
            gd, ga, gn = (np.concatenate(x) for x in zip(*gone))
            zero = np.zeros(len(gd), np.uint64)
            yield pack(buckets, np.append(left[asks], zero), np.append(right[asks], zero), np.append(d[asks], gd), np.append(at[asks], ga), np.append(np.ones(len(asks), np.int64), gn), np.repeat([ASK, GONE], [len(asks), len(gd)]), ids, digests)

    return run


def _settle_windows(t: pa.Table) -> pa.Table:
    """Of equal windows the first stays, and the later ones go."""
    left, right, ids, digests, at, n, kind = unpack(t)
    asked = np.flatnonzero(kind == ASK)
    order, _, same = _first_places(left[asked], right[asked], ids[asked], digests[asked], at[asked])
    keep = kind == GONE
    keep[asked[order[~same]]] = True
    return _by_document(ids[keep], digests[keep], at[keep], n[keep], np.full(int(keep.sum()), GONE))


def _cover(width: int):
    def run(batches):
        for t in chunks(batches, "text", 4 << 20):
            total, removed, kept = [], [], []
            for text, p in zip(t.column("text").to_pylist(), t.column("gone").to_pylist()):
                words = (text or b"").split()
                total.append(len(words))
                lost = 0
                at, n = _runs(p or [])
                if len(at):
                    cover = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + n + (width - 1), minlength=len(words) + 1)
                    stay = np.cumsum(cover)[:-1] == 0
                    lost = len(words) - int(stay.sum())
                    words = [words[i] for i in np.flatnonzero(stay)]
                removed.append(lost)
                kept.append(b" ".join(words))
            t = t.drop_columns(["text", "gone"])
            for name, x, kind in (("n_words", total, pa.int64()), ("n_removed", removed, pa.int64()), ("kept", kept, pa.binary())):
                t = t.append_column(name, pa.array(x, kind))
            yield from t.to_batches()

    return run


_GROUPED = "id long, digest long, gone binary, open binary"


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """docs with n_words, n_removed and kept_text (the kept words joined by one space), under those names or, where docs has them, with underscores in front."""
    spark = docs.sparkSession
    buckets = 4 * partitions(spark)
    key_id, digest = fresh(docs, "key_id"), fresh(docs, "key_digest")
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.withColumns({key_id: F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), digest: F.xxhash64(text)})
    keyed = docs.select(F.col(key_id).alias("id"), F.col(digest).alias("digest"), text.cast("binary").alias("text"))

    names = keyed.mapInArrow(_send_names(width, buckets), _BLOBS)
    settled = names.groupBy("bucket").applyInArrow(_settle_names, _GROUPED).groupBy("id", "digest").agg(F.collect_list("gone").alias("gone"), F.collect_list("open").alias("open"))
    windows = keyed.join(settled, ["id", "digest"]).mapInArrow(_send_windows(width, buckets), _BLOBS)
    later = windows.groupBy("bucket").applyInArrow(_settle_windows, _GROUPED).groupBy("id", "digest").agg(F.collect_list("gone").alias("gone"))

    outs = {c: fresh(docs, c) for c in ("n_words", "n_removed", "kept_text")}
    rest = [c for c in docs.columns if c not in (text_col, key_id, digest)]
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.col(key_id).alias("id"), F.col(digest).alias("digest"), F.col(text_col).cast("binary").alias("text"))
    joined = plain.join(cut(later), ["id", "digest"], "left").select(*[f"c{i}" for i in range(len(rest))], "text", "gone")
    kinds = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)]
    done = joined.mapInArrow(_cover(width), ", ".join([*kinds, "n_words long, n_removed long, kept binary"]))
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], F.col("n_words").alias(outs["n_words"]), F.col("n_removed").alias(outs["n_removed"]), F.col("kept").cast("string").alias(outs["kept_text"]))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], width: int = WIDTH) -> list[tuple[int | None, int, int, str]]:
    """What op2 returns, for a few documents with different ids, by a table of all windows."""
    docs = sorted(((i, (t or "").encode().split()) for i, t in rows), key=lambda x: NULL_ID if x[0] is None else x[0])
    seen, out = set(), []
    for i, words in docs:
        cover = [False] * len(words)
        for a in range(len(words) - width + 1):
            key = tuple(words[a : a + width])
            if key in seen:
                cover[a : a + width] = [True] * width
            seen.add(key)
        kept = b" ".join(w for w, c in zip(words, cover) if not c)
        out.append((i, len(words), sum(cover), hashlib.sha256(kept).hexdigest()))
    return out


QUERIES = {"op2_substring": op2_substring}
ORACLE: dict[str, str] = {
    "op2_substring": f"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {WIDTH - 1}], ' ') AS k FROM d, LATERAL (SELECT unnest(range(1, len(w) - {WIDTH - 2})) AS i)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS place FROM later, range({WIDTH}) t(j)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS t FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
}
