"""Preparation of pair features: cleaning, distance to similarity, clipping, scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = ("S_token", "S_AST", "S_structure", "unixcoder_cosine", "unixcoder_l2", "unixcoder_manhattan", "S_PDG", "pdg_valid")
DISTANCES = ("unixcoder_l2", "unixcoder_manhattan")


def clean(c: Column) -> Column:
    """A number; what is none, null, NaN or infinite is 0."""
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def to_similarity(d: Column) -> Column:
    return 1 / (1 + F.greatest(d, F.lit(0.0)))


def clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def prepare(pairs: DataFrame, features=FEATURES, distances=DISTANCES) -> DataFrame:
    """pairs with its features cleaned, distances turned into similarities, all clipped to [0, 1]."""
    return pairs.withColumns({c: clip(to_similarity(clean(F.col(c))) if c in distances else clean(F.col(c))) for c in features})


def labelled(pairs: DataFrame) -> DataFrame:
    """pairs with an integer GroundTruth: as given, else whether both files are of one problem; without either an error."""
    if "GroundTruth" in pairs.columns:
        return pairs.withColumn("GroundTruth", F.col("GroundTruth").cast("int"))
    if {"problem_1", "problem_2"} <= set(pairs.columns):
        return pairs.withColumn("GroundTruth", (F.col("problem_1") == F.col("problem_2")).cast("int"))
    raise ValueError("neither GroundTruth nor problem_1 and problem_2 are there")


def fit_scaler(train: DataFrame, features=FEATURES) -> dict[str, tuple[float, float]]:
    """Least and greatest value of each feature, in one aggregation."""
    r = train.agg(*[f(c).alias(f"{n}_{c}") for c in features for n, f in (("min", F.min), ("max", F.max))]).first()
    return {c: (r[f"min_{c}"], r[f"max_{c}"]) for c in features}


def scale(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Features scaled by the fitted ranges and clipped; a constant feature has width 1, so that its value becomes 0."""
    return df.withColumns({c: clip((F.col(c) - F.lit(lo)) / F.lit(hi - lo if hi != lo else 1.0)) for c, (lo, hi) in ranges.items()})
