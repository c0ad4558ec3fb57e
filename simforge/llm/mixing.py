"""Mixing sources to target weights by subset sums.

A target of words is set for each source (water filling under a cap of `most` times the source's own words).  The
documents of a source are counted by exact length.  Whole passes over the source are taken first; of the next pass the
same share of each length is taken, and what is left of the budget is filled exactly by bounded-knapsack dynamic
programming over the lengths still free.  Of each length the documents with the least seeded hashes are the ones taken.

The program runs once per source over its lengths and counts, never over documents.  Sources and (source, length) pairs
stay distributed tables.

Defined results: a null text has no words, and such documents are never needed and take 0; a null source is a source and
comes last; repeated rows have the same hash, and which of them is taken is arbitrary; without any words all targets and
taken words are 0; an empty table gives no rows; very long texts are one long document each; other columns pass through,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simforge.llm.common import cut, fresh, ranked, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 4_021
#: Budget left to the dynamic program: units of the longest length, and words at least; rounding down adds one unit at most.
RESERVE = 4
EXACT = 1 << 16
#: Up to so many (source, length) pairs are sent to all tasks.
FEW_LENGTHS = 500_000


def n_words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def subset_sum(lengths: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take, at most free of it, for the largest sum not over budget.

    Reachable sums are the bits of a number; a bounded count enters by doubling shares, and the way back goes through the
    numbers kept before each share.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    mask, reach = (1 << (budget + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        length, left, share = int(lengths[i]), int(min(free[i], budget // lengths[i])), 1
        while left > 0 and not reach >> budget & 1:
            k = min(share, left)
            steps.append((int(i), k, reach))
            reach |= (reach << (k * length)) & mask
            left, share = left - k, share * 2
        if reach >> budget & 1:
            break
    total = reach.bit_length() - 1
    for i, k, before in reversed(steps):
        if not before >> total & 1:
            take[i] += k
            total -= k * int(lengths[i])
    return take


def choose(lengths: np.ndarray, counts: np.ndarray, target: float, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """For each length: whole passes, and how many documents are taken once more.  Words taken come as near target as from below."""
    lengths, counts = np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    more = np.zeros(len(lengths), dtype=np.int64)
    real = lengths > 0
    total = int((lengths * counts).sum())
    if not total:
        return np.zeros(len(lengths), dtype=np.int64), more
    goal = min(int(target), most * total)
    passes = min(goal // total, most)
    rest = goal - passes * total
    base = np.where(real, passes, 0)
    if passes == most or not rest:
        return base, more
    # the same share of each length, but for a reserve; then, longest first, what rounding down has left beyond the reserve
    reserve = max(RESERVE * int(lengths.max()), EXACT)
    more[real] = np.floor(counts[real] * max(0.0, (rest - reserve) / total)).astype(np.int64)
    rest -= int((more * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if lengths[i] and (k := min(int(counts[i] - more[i]), (rest - reserve) // int(lengths[i]))) > 0:
            more[i] += k
            rest -= k * int(lengths[i])
    fits = real & (counts > more)
    if rest > 0 and fits.any():
        more[fits] += subset_sum(lengths[fits], (counts - more)[fits], rest)
    return base, more


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (source, source_size) with `target`: share of all words dealt by weight, none over most times its own size.

    Sources in code-point order, null last, have the weights in turn.  The level at which the budget is used up is read
    from the sources ordered by cap per weight.  One row per source; a source is a name, so one task orders them.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.array(*[F.lit(float(x)) for x in weights])
    t = sizes.withColumn("w", F.get(w, (F.row_number().over(by_name) - 1) % len(weights))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    all_rows = Window.partitionBy()
    t = t.withColumn("budget", F.sum("source_size").over(all_rows) * F.lit(float(share)))
    t = t.withColumn("below", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("heavy", F.sum("w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    # the level if all sources before this one stop at their caps and the others share what is left
    t = t.withColumn("level", F.when((F.col("budget") - F.col("below")) / F.col("heavy") <= F.col("cap") / F.col("w"), (F.col("budget") - F.col("below")) / F.col("heavy")))
    t = t.withColumn("level", F.first("level", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return t.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, source_col: str, size_col: str, key_cols: list[str], seed: int = SEED, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """docs with source_size, target (of the source) and copies (times the document is taken)."""
    n, s, rank, order, of_source, of_length, of_size, of_target, base, more = (fresh(docs, x) for x in ("mix_size", "mix_source", "mix_rank", "mix_order", "p_source", "p_length", "p_source_size", "p_target", "base", "more"))
    outs = [fresh(docs, x) for x in ("source_size", "target", "copies")]
    keep = docs.columns
    docs = docs.withColumns({n: F.col(f"`{size_col}`"), s: F.col(f"`{source_col}`"), order: F.xxhash64(*[F.col(f"`{c}`") for c in key_cols], F.lit(seed))})
    counts = docs.groupBy(F.col(s).alias("source"), F.col(n).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    goal = targets(counts.groupBy("source").agg(F.sum(F.col("length") * F.col("n")).alias("source_size")), weights, share, most)

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("length", ignore_index=True)
        passes, once = choose(pdf["length"].to_numpy(), pdf["n"].to_numpy(), float(pdf["target"].iloc[0]), most)
        return pd.DataFrame({"source": pdf["source"], "length": pdf["length"], "source_size": pdf["source_size"], "target": pdf["target"], "passes": passes, "once": once})

    c, g = counts.alias("c"), goal.alias("g")
    chosen = c.join(g, F.col("c.source").eqNullSafe(F.col("g.source"))).select("c.source", "length", "n", "source_size", "target")
    chosen = cut(chosen.groupBy("source").applyInPandas(plan, "source string, length long, source_size long, target double, passes long, once long"))
    chosen = chosen.withColumnsRenamed({"source": of_source, "length": of_length, "source_size": of_size, "target": of_target, "passes": base, "once": more})
    if chosen.count() <= FEW_LENGTHS:  # checked: at most some tens of MB; else both sides are dealt by source and length
        chosen = F.broadcast(chosen)
    docs = ranked(docs, [s, n], order, rank)
    docs = docs.join(chosen, F.col(s).eqNullSafe(F.col(of_source)) & (F.col(n) == F.col(of_length)))
    copies = F.col(base) + F.when(F.col(rank) < F.col(more), 1).otherwise(0)
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(of_size).alias(outs[0]), F.col(of_target).alias(outs[1]), copies.alias(outs[2]))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cut(table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("code")))
    mixed = mix(docs, "source", "size", ["doc_id", "code"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets that op7 fills, and whether what it takes is near them: within the longest document, and no more than the target."""
    docs = cut(table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("code")))
    mixed = mix(docs, "source", "size", ["doc_id", "code"])
    sums = mixed.groupBy("source", "source_size", F.round("target", 3).alias("target")).agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.max("size").alias("longest"))
    return sums.select("source", "source_size", "target", ((F.col("t") <= F.col("target") + 1) & (F.col("t") >= F.col("target") - F.col("longest") - 1)).alias("near"))


QUERIES = {"op7_mixing": op7_mixing, "mixing_targets": mixing_targets}
#: Water filling: the level is that of the first source, by cap for its weight, whose cap the level does not reach.
ORACLE: dict[str, str] = {
    "mixing_targets": f"""WITH s AS (SELECT source, sum(len(list_filter(string_split_regex(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '')))::BIGINT AS source_size FROM documents GROUP BY source),
r AS (SELECT *, ({list(WEIGHTS)})[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1]::DOUBLE AS w, {MOST} * source_size AS cap, {SHARE} * sum(source_size) OVER () AS budget FROM s),
l AS (SELECT a.source, a.cap / a.w AS ratio, (a.budget - coalesce((SELECT sum(b.cap) FROM r b WHERE b.cap / b.w < a.cap / a.w), 0)) / (SELECT sum(b.w) FROM r b WHERE b.cap / b.w >= a.cap / a.w) AS level FROM r a),
best AS (SELECT min(level) AS level FROM (SELECT level FROM l WHERE level <= ratio ORDER BY ratio LIMIT 1))
SELECT source, source_size, round(least(cap, coalesce(level * w, cap)), 3)::DOUBLE AS target, true AS near FROM r, best""",
}
