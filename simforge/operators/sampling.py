"""Seeded samples and splits.  All are functions of a key's hash: they don't depend on partitions or on run order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(key: list[str], seed: int) -> list[Column]:
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key])
    return [F.md5(text.cast("binary")), *[F.col(c) for c in key]]


def _ranked(df: DataFrame, label: str, key: list[str], seed: int) -> DataFrame:
    """df with __rank (from 0, by hash) and __n of each label.

    Rows are numbered inside 256 slices of the hash, after the rows of the slices before: a label of two values does not
    put all rows in two tasks.
    """
    order = _order(key, seed)
    df = df.withColumn("__cell", F.substring(order[0], 1, 2))
    sizes = df.groupBy(F.col(label).alias("__of"), F.col("__cell").alias("__at")).agg(F.count(F.lit(1)).alias("__size"))
    in_label = Window.partitionBy("__of")
    before = F.coalesce(F.sum("__size").over(in_label.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__of", "__at", before.alias("__before"), F.sum("__size").over(in_label).alias("__n"))
    df = df.withColumn("__rank", F.row_number().over(Window.partitionBy(label, "__cell").orderBy(*order)) - 1)
    joined = df.join(sizes, F.col(label).eqNullSafe(F.col("__of")) & (F.col("__cell") == F.col("__at")))
    return joined.withColumn("__rank", F.col("__rank") + F.col("__before")).drop("__cell", "__of", "__at", "__before")


def reservoir(df: DataFrame, label: str, caps: dict, key: list[str], seed: int = 42) -> DataFrame:
    """A uniform sample of caps[label] rows of each label: those with the least hashes."""
    cap = F.lit(None).cast("long")
    for value, n in caps.items():
        cap = F.when(F.col(label) == F.lit(value), F.lit(n)).otherwise(cap)
    known = df.where(F.col(label).isin(list(caps)))
    return _ranked(known, label, key, seed).where(F.col("__rank") < cap).drop("__rank", "__n")


def downsample(df: DataFrame, label: str, ratio: int, key: list[str], seed: int = 42) -> DataFrame:
    """All positives and at most ratio times as many negatives, those with the least hashes."""
    n = df.where(F.col(label) == 1).count()
    negatives = _ranked(df.where(F.col(label) == 0), label, key, seed).where(F.col("__rank") < ratio * n).drop("__rank", "__n")
    return df.where(F.col(label) == 1).unionByName(negatives)


def shuffled(df: DataFrame, key: list[str], seed: int = 42) -> DataFrame:
    return df.orderBy(*_order(key, seed))


def stratified_split(df: DataFrame, label: str, key: list[str], test: float = 0.2, valid: float = 0.16, seed: int = 42) -> DataFrame:
    """df with `split`: test, valid or train, in these parts of each label."""
    at = F.col("__rank") / F.col("__n")
    return _ranked(df, label, key, seed).withColumn("split", F.when(at < test, "test").when(at < test + valid, "valid").otherwise("train")).drop("__rank", "__n")


def stratified_folds(df: DataFrame, label: str, key: list[str], folds: int = 5, seed: int = 42) -> DataFrame:
    return _ranked(df, label, key, seed).withColumn("fold", (F.col("__rank") % folds).cast("int")).drop("__rank", "__n")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """df with `weight`, the inverse of its class's frequency."""
    sizes = df.groupBy(F.col(label).alias("__of")).agg(F.count(F.lit(1)).alias("__size"))
    return df.join(sizes, F.col(label).eqNullSafe(F.col("__of"))).withColumn("weight", F.lit(1.0) / F.col("__size")).drop("__of", "__size")
