"""Toxicity: a logistic classifier on word and word-stem presence, regularised by counterfactuals.

Each labelled sentence that names an identity term is written again with the term exchanged for another of its group.  The
loss adds `swap_penalty` times the squared change of the logit, so that a neutral mention of a group moves no score.  The
change depends only on the features that the exchange takes and gives; such pairs are counted before they leave a task.

The fit takes at most `max_rows` labelled rows, those with the least hash of the id (a bounded sample, as a parameter).
Features are chosen over that sample by a distributed count of documents per class: those whose shares in the two classes
are at least `min_z` standard deviations apart.  The `n_features` chosen ones and the sample's rows of chosen features go to the driver, both bounded by parameters.  Every whole text is scored.

Defined results: a null or empty text gets the score of a text without features; a null id belongs to the rows with the
remainder of the empty text; labels that are null are not learnt from, and of several labels of one id the largest holds;
rows with the same id and text are learnt from once, and repeated rows are each scored; without any labels, or with labels
of 0 alone, all scores are 0, with labels of 1 alone all are 1; weights below 1e-3, which change no score by more than
0.001 each, are left out of the model; texts of any length are scored whole; other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simforge.llm.common import crc_mod, fresh, table, trim

#: Groups of terms that may stand for one another.
IDENTITY = (
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("girls", "boys"), ("female", "male"), ("mother", "father"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"), ("african", "european", "american", "chinese", "mexican", "indian"),
    ("gay", "straight", "lesbian", "bisexual", "queer"), ("transgender", "cisgender"),
    ("immigrant", "native"), ("immigrants", "natives"), ("disabled", "deaf", "blind"), ("old", "young"),
    ("he", "she"), ("him", "her"), ("his", "hers"), ("himself", "herself"), ("er", "sie"), ("ihn", "ihr"), ("il", "elle"), ("ils", "elles"), ("él", "ella"), ("ellos", "ellas"),
    ("frau", "mann"), ("frauen", "männer"), ("femme", "homme"), ("femmes", "hommes"), ("mujer", "hombre"), ("mujeres", "hombres"),
)

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?\n]+")
STEMS = (4, 5)


@dataclass(frozen=True)
class Settings:
    max_rows: int = 20_000
    n_features: int = 8_192
    min_docs: int = 4
    min_z: float = 5.0
    ridge: float = 1e-5
    swap_penalty: float = 1.0
    steps: int = 800
    threshold: float = 0.7
    identity: tuple = IDENTITY


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float
    settings: Settings

    def score(self, texts: list[str | None], memo: dict[str, tuple] | None = None) -> np.ndarray:
        """Scores from 0 to 1; memo: the features that words have, kept from batch to batch."""
        memo = {} if memo is None else memo
        get, weights = memo.get, self.weights
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            found = set()
            for w in set(_WORD.findall((text or "").lower())):
                hit = get(w)
                if hit is None:
                    if len(memo) > 100_000:
                        memo.clear()
                    hit = memo[w] = tuple(f for f in features_of(w) if f in weights)
                if hit:
                    found.update(hit)
            out[i] = self.bias + sum(weights[f] for f in sorted(found))
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def features_of(word: str) -> list[str]:
    """The word itself and its stems of fixed lengths; a mark in front tells them apart."""
    return ["=" + word, *("^" + word[:k] for k in STEMS if len(word) > k)]


def features(text: str | None) -> set[str]:
    return {f for w in set(_WORD.findall((text or "").lower())) for f in features_of(w)}


def swapper(identity):
    """A function that exchanges each identity term of a lower-case text for the next of its group."""
    to = {t: g[(i + 1) % len(g)] for g in identity for i, t in enumerate(g)}
    if not to:
        return lambda text: text
    find = re.compile(r"\b(" + "|".join(sorted(map(re.escape, to), key=len, reverse=True)) + r")\b")
    return lambda text: find.sub(lambda m: to[m[0]], text)


def _counts(batches):
    for batch in batches:
        n: tuple[Counter, Counter] = (Counter(), Counter())
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
            n[y].update(features(text))
        keys = list(n[0].keys() | n[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([n[0][k] for k in keys], pa.int64()), pa.array([n[1][k] for k in keys], pa.int64())], names=["f", "n0", "n1"])


def _rows(chosen: dict[str, int], identity):
    swap = swapper(identity)

    def code(f) -> bytes:
        return np.array(sorted(chosen[x] for x in f if x in chosen), dtype=np.int32).tobytes()

    def run(batches):
        for batch in batches:
            ys, xs, pairs = [], [], Counter()
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                ys.append(y)
                xs.append(code(features(text)))
                for s in _SENTENCE.split((text or "").lower()):
                    if (t := swap(s)) != s:
                        a, b = features(s), features(t)
                        pairs[code(a - b), code(b - a)] += 1
            pairs.pop((b"", b""), None)
            n, m = len(ys), len(pairs)
            both, times = list(pairs), [pairs[k] for k in pairs]
            yield pa.RecordBatch.from_arrays([pa.array(ys + [None] * m, pa.int32()), pa.array(xs + [a for a, _ in both], pa.binary()), pa.array([None] * n + [b for _, b in both], pa.binary()), pa.array([None] * n + times, pa.int64())], names=["y", "x", "other", "n"])

    return run


def _flat(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(c, dtype=np.int32) for c in codes]
    return np.concatenate([np.zeros(0, np.int32), *parts]), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def fit_rows(ys: np.ndarray, xs: list[bytes], pairs: dict[tuple[bytes, bytes], int], n: int, s: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam on class-balanced log loss, ridge and the squared logit change of each pair, as often as it occurs."""
    times = np.array(list(pairs.values()), dtype=float)
    pairs = list(pairs)
    col, row = _flat(xs)
    a_col, a_row = _flat([p[0] for p in pairs])
    b_col, b_row = _flat([p[1] for p in pairs])
    w, b = np.zeros(n), 0.0
    pos = max(1, int(ys.sum()))
    neg = max(1, len(ys) - pos)
    weight = np.where(ys == 1, 0.5 / pos, 0.5 / neg)
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, s.steps + 1):
        z = b + np.bincount(row, w[col], len(ys))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - ys)
        grad = np.append(np.bincount(col, g[row], n) + 2 * s.ridge * w, g.sum())
        if pairs:
            d = (np.bincount(a_row, w[a_col], len(pairs)) - np.bincount(b_row, w[b_col], len(pairs))) * (2 * s.swap_penalty * times / times.sum())
            grad[:n] += np.bincount(a_col, d[a_row], n) - np.bincount(b_col, d[b_row], n)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        w -= step[:n]
        b -= step[n]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from the rows of labels (id_col, label_col) whose document is in docs."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    known = known.where(F.col("y").isin(0, 1)).orderBy(F.xxhash64("i", F.lit(7)), "i").limit(s.max_rows)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).join(F.broadcast(known), "i").groupBy("i", "y", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).select("text", "y")
    rows = rows.persist()
    try:
        counts = rows.mapInArrow(_counts, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        size = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
        n0, n1 = size.get(0, 0), size.get(1, 0)
        if not n0 or not n1:
            return Model({}, -800.0 if not n1 else 800.0, s)
        # how far the two classes' shares of documents are apart, in standard deviations
        p0, p1 = (F.col("n0") + 0.5) / (n0 + 1), (F.col("n1") + 0.5) / (n1 + 1)
        p = (F.col("n0") + F.col("n1") + 1.0) / (n0 + n1 + 2)
        far = F.abs(p1 - p0) / F.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))
        top = counts.where((F.col("n0") + F.col("n1") >= s.min_docs) & (far >= s.min_z)).select("f", "n0", "n1").orderBy(far.desc(), "f").limit(s.n_features)
        names = [r["f"] for r in top.collect()]
        names += sorted({f for g in s.identity for t in g for f in features_of(t)} - set(names))
        got = rows.mapInArrow(_rows({f: i for i, f in enumerate(names)}, s.identity), "y int, x binary, other binary, n long")
        got = got.groupBy("y", "x", "other").agg(F.sum(F.coalesce("n", F.lit(1))).alias("n")).toArrow()
    finally:
        rows.unpersist()
    # in order, so that the order of tasks changes no digit
    rows_of = sorted(zip(got.column("y").to_pylist(), got.column("x").to_pylist(), got.column("other").to_pylist(), got.column("n").to_pylist()), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or b""))
    own = [r for r in rows_of if r[0] is not None]
    ys = np.repeat([r[0] for r in own], [r[3] for r in own])
    xs = [r[1] for r in own for _ in range(r[3])]
    w, b = fit_rows(ys, xs, {(r[1], r[2]): r[3] for r in rows_of if r[0] is None}, len(names), s)
    return Model({f: float(x) for f, x in zip(names, w) if abs(x) > 1e-3}, b, s)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a column of scores, under out or, where docs has that, with underscores in front."""
    out = fresh(docs, out)
    rest = docs.columns
    cols = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]
    at = f"c{rest.index(next(c for c in rest if c.lower() == text_col.lower()))}"

    def run(batches):
        memo: dict[str, tuple] = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(batch.column(at).to_pylist(), memo))], names=[*batch.schema.names, "score"])
        memo.clear()
        trim()

    kinds = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)]
    return docs.select(*cols).mapInArrow(run, ", ".join([*kinds, "score double"])).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], F.col("score").alias(out))


def learnable(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of the folds that may be learnt from."""
    return df.where(crc_mod(F.col(id_col), 3) != 1)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, learnable(table(spark, sf_dir, "labels")))
    scored = score(docs, model).select("doc_id", "score")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= model.settings.threshold, 1).otherwise(0).alias("predicted"))


def cross_validated(docs: DataFrame, labels: DataFrame, choices: list[Settings], folds: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list[tuple[Settings, int, int, int]]:
    """For each choice: toxic rows found, toxic rows, and others flagged, over folds (by a hash of the id) of the rows that may be learnt from.

    The settings' defaults were chosen by this; held-out rows take no part in it.
    """
    known = learnable(labels.where(F.col(label_col).isNotNull()), id_col)
    fold = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(folds))
    out = []
    for s in choices:
        sums = np.zeros(3, np.int64)
        for k in range(folds):
            model = fit(docs, known.where(fold != k), s, id_col, text_col, label_col)
            test = docs.join(known.where(fold == k).select(F.col(id_col), F.col(label_col).alias("truth")), id_col)
            hit = F.col("model_score") >= s.threshold
            r = score(test, model, text_col, "model_score").agg(F.sum((hit & (F.col("truth") == 1)).cast("int")), F.sum((F.col("truth") == 1).cast("int")), F.sum((hit & (F.col("truth") == 0)).cast("int"))).first()
            sums += np.array([x or 0 for x in r])
        out.append((s, *sums.tolist()))
    return out


def swap_gap(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """One row: the texts that name an identity term, and how far on average and at most an exchange of terms moves their scores."""
    swap = swapper(model.settings.identity)

    def run(batches):
        for batch in batches:
            low = [(t or "").lower() for t in batch.column(0).to_pylist()]
            named = [(t, x) for t in low if (x := swap(t)) != t]
            gap = np.abs(model.score([t for t, _ in named]) - model.score([x for _, x in named])) if named else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(gap)], names=["gap"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "gap double").agg(F.count("gap").alias("texts"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("most_gap"))


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLE: dict[str, str] = {}
