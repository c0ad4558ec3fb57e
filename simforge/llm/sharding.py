"""Sharding by a hypergeometric communication matrix: a uniform shuffle into shards of exact sizes.

Rows lie in blocks by the hash of their contents.  The matrix that says how many rows each block sends to each shard is
drawn, row by row, from the multivariate hypergeometric distribution given the block sizes and the shard sizes, as a
uniform permutation would have it.  Each block is permuted by a keyed hash and cut at the running sums of its matrix row;
each shard is permuted again by a second keyed hash, which gives the slots.  Shard sizes differ by one row at most.

Blocks and slices of a shard, not whole shards, are what one task sorts; only the number of rows of each block (one block
for each BLOCK_ROWS rows, and LEAST_BLOCKS at least) goes to the driver.  A draw looks at DEVIATIONS standard deviations
around the mode, so that its cost grows with the root of a block's rows, at any size by the same method.

Defined results: a row's place depends on its key columns, the number of equal rows and the seed, not on how the input is
dealt over tasks; a null text counts as empty; repeated rows lie apart, told from one another by a running number, and go
to places drawn each for itself (which of equal rows goes where is arbitrary); an empty table gives no rows; a null doc_id
is hashed as a null; texts of any length count by their keys alone; other columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simforge.llm.common import cut, fresh, ranked, table

SHARDS = 40
SEED = 20_011
LEAST_BLOCKS, BLOCK_ROWS = 64, 1 << 20
#: Copies of one row are numbered inside so many parts, so that a hot row does not lie in one task.
COPY_PARTS = 256
DEVIATIONS = 13


def _log_rise(x: float, d: np.ndarray) -> np.ndarray:
    """log((x + d)! / x!) without the cancellation of two large logarithms of factorials; x + d >= 0."""
    y = x + d
    tail = lambda v: 1 / (12 * (v + 1)) - 1 / (360 * (v + 1) ** 3) + 1 / (1260 * (v + 1) ** 5)
    large = np.minimum(x, y) >= 32
    out = d * np.log(x + 1.0) + (y + 0.5) * np.log1p(np.where(large, d, 0) / (x + 1.0)) - d + tail(y) - tail(x)
    for i in np.flatnonzero(~large):  # few factors: their logarithms one by one
        a, b = sorted((int(x), int(y[i])))
        out[i] = np.log(np.arange(a + 1, b + 1)).sum() * (1 if y[i] >= x else -1)
    return out


def hypergeometric(good: int, bad: int, draws: int, u: float) -> int:
    """The number of good ones among draws out of good + bad, by inversion of u from (0, 1); for numbers of any size.

    The weights are those of the distribution divided by the mode's; what lies beyond DEVIATIONS standard deviations (and 32
    more) has less than 10**-30 of them.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    n = good + bad
    mode = min(max((draws + 1) * (good + 1) // (n + 2), low), high)
    p = good / n
    reach = int(DEVIATIONS * (draws * p * (1 - p) * (n - draws) / max(1, n - 1)) ** 0.5) + 32
    d = np.arange(max(low - mode, -reach), min(high - mode, reach) + 1).astype(np.float64)
    log_weight = -(_log_rise(mode, d) + _log_rise(good - mode, -d) + _log_rise(draws - mode, -d) + _log_rise(bad - draws + mode, d))
    total = np.cumsum(np.exp(log_weight))
    return mode + int(d[min(np.searchsorted(total, u * total[-1], side="right"), len(d) - 1)])


def matrix(blocks: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Rows that each block sends to each shard: row sums are blocks, column sums are shards."""
    rng = np.random.default_rng(seed)
    left = [int(x) for x in shards]
    out = np.zeros((len(blocks), len(shards)), dtype=np.int64)
    for i, n in enumerate(blocks):
        # shard by shard, how many of the block's n rows fall among its free places
        places, rest, u = sum(left), int(n), rng.random(len(left))
        for j in range(len(left)):
            if not rest:
                break
            places -= left[j]
            k = hypergeometric(left[j], places, rest, u[j])
            out[i, j] = k
            rest -= k
            left[j] -= k
    return out


def even(n: int, shards: int) -> list[int]:
    return [n // shards + (j < n % shards) for j in range(shards)]


def shard(docs: DataFrame, key_cols: list[str], n_shards: int = SHARDS, seed: int = SEED, n_blocks: int | None = None, out: tuple[str, str] = ("shard", "slot")) -> DataFrame:
    """docs with the shard (from 0) and the slot in the shard (from 0, without gaps) of each row.

    key_cols: columns whose values make a row's place, together with the seed; rows that agree in all of them are exchanged
    for one another only.  n_blocks: blocks of the matrix, by default by the number of rows.
    """
    spark = docs.sparkSession
    names = [fresh(docs, n) for n in out]
    block, order, copy, slot0, part, cuts_col, every = (fresh(docs, x) for x in ("block", "order_in_block", "copy_no", "at_in_block", "copy_part", "cut_points", "whole_row"))
    keys = [F.col(f"`{c}`") for c in key_cols]
    plain = [F.col(f"`{f.name}`") for f in docs.schema if not f.dataType.simpleString().startswith(("map", "variant", "struct", "array"))]
    # stored, so that counting and dealing see the same parts whatever order the input comes in
    docs = cut(docs.withColumn(part, F.pmod(F.monotonically_increasing_id(), F.lit(COPY_PARTS)).cast("int")))
    n = docs.count()
    n_blocks = n_blocks or max(LEAST_BLOCKS, -(-n // BLOCK_ROWS))
    # equal rows have the numbers 1 to n: inside a part first, after those of the parts before
    docs = docs.withColumn(every, F.xxhash64(*plain))
    in_part = Window.partitionBy(*keys, part)
    docs = docs.withColumn(copy, F.row_number().over(in_part.orderBy(every)))
    counts = docs.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    renamed = [f"k{i}" for i in range(len(keys))]
    counts = counts.withColumn("before", F.sum("n").over(before)).where("before is not null").select(*[k.alias(r) for k, r in zip(keys, renamed)], F.col(part).alias("p"), "before")
    on = (F.col(f"d.{part}") == F.col("c.p"))
    for c, r in zip(key_cols, renamed):
        on = on & F.col(f"d.`{c}`").eqNullSafe(F.col(f"c.{r}"))
    docs = docs.alias("d").join(counts.alias("c"), on, "left").select("d.*", F.col("c.before").alias(slot0))
    code = F.xxhash64(*keys, F.col(copy) + F.coalesce(F.col(slot0), F.lit(0)), F.lit(seed))
    docs = docs.withColumn(order, code).drop(slot0).withColumn(block, F.pmod(F.xxhash64(order, F.lit(1)), F.lit(n_blocks)).cast("int"))
    sizes = {r[block]: r["count"] for r in docs.groupBy(block).count().collect()}
    blocks = [sizes.get(b, 0) for b in range(n_blocks)]
    m = matrix(blocks, even(sum(blocks), n_shards), seed)
    ends = np.cumsum(m, axis=1).tolist()
    docs = ranked(docs, [block], order, slot0, slices=1)
    cuts = spark.createDataFrame([(b, ends[b]) for b in range(n_blocks)], f"`{block}` int, `{cuts_col}` array<long>")
    docs = docs.join(F.broadcast(cuts), block)  # n_shards numbers for each BLOCK_ROWS rows
    docs = docs.withColumn(names[0], F.size(F.filter(F.col(cuts_col), lambda e: e <= F.col(slot0))))
    docs = docs.withColumn(order, F.xxhash64(order, F.lit(2)))
    slices = max(64, -(-n // (n_shards * BLOCK_ROWS)))
    return ranked(docs, [names[0]], order, names[1], slices).drop(block, order, copy, part, slot0, cuts_col, every)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    done = shard(docs, ["doc_id", "size", "text_crc32"])
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharding_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the law says of op6's shards: their rows, and that slots run from 0 without gaps."""
    return op6_sharding(spark, sf_dir).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("first"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots"))


QUERIES = {"op6_sharding": op6_sharding, "sharding_law": sharding_law}
ORACLE: dict[str, str] = {
    "sharding_law": f"WITH d AS (SELECT count(*) AS c FROM documents), s AS (SELECT i::INTEGER AS shard, c // {SHARDS} + CASE WHEN i < c % {SHARDS} THEN 1 ELSE 0 END AS n FROM d, range({SHARDS}) t(i)) SELECT shard, n, 0::BIGINT AS first, n - 1 AS last, n AS slots FROM s WHERE n > 0",
}
