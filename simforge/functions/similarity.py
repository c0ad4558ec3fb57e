"""Pair similarities and distances as Catalyst expressions; empty against empty is 0, not 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def set_dice(a: Column, b: Column) -> Column:
    """2|A and B| / (|A| + |B|) of arrays of distinct values."""
    return _ratio(F.size(F.array_intersect(a, b)) * 2.0, F.size(a) + F.size(b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def unit_l2_similarity(a: Column, b: Column) -> Column:
    """1 / (1 + distance) of the two vectors, each over its norm + 1e-9."""
    na, nb = F.sqrt(dot(a, a)) + 1e-9, F.sqrt(dot(b, b)) + 1e-9
    return 1 / (1 + l2(F.transform(a, lambda x: x / na), F.transform(b, lambda x: x / nb)))


def round4(x: Column) -> Column:
    """Four places, halves to even on the scaled value."""
    return F.rint(x * 10000) / 10000
