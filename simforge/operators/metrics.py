"""Evaluation as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOW, HIGH = 30, 95


def _over(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _scores(df: DataFrame) -> DataFrame:
    """tp, fp, fn, tn and what follows from them; 0 where a denominator is."""
    p, r = _over(F.col("tp"), F.col("tp") + F.col("fp")), _over(F.col("tp"), F.col("tp") + F.col("fn"))
    df = df.withColumns({"accuracy": _over(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), "precision": p, "recall": r})
    return df.withColumn("f1", _over(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def confusion(df: DataFrame, label: Column, predicted: Column) -> DataFrame:
    """One row: tp, fp, fn, tn, accuracy, precision, recall, f1."""
    n = lambda y, z: F.coalesce(F.sum(((label == y) & (predicted == z)).cast("long")), F.lit(0)).cast("long")
    return _scores(df.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn")))


def threshold_sweep(df: DataFrame, label: Column, probability: Column) -> DataFrame:
    """Scores at each threshold from 0.30 to 0.95 in steps of 0.01.

    Rows are counted once by the highest threshold they reach; sums from above give the counts at each threshold, so that
    the data is not repeated for each.
    """
    spark = df.sparkSession
    steps = F.array(*[F.lit(t / 100) for t in range(LOW, HIGH + 1)])
    step = F.size(F.filter(steps, lambda t: probability >= t)) + F.lit(LOW - 1)
    counts = df.select(step.alias("t"), label.cast("int").alias("y")).groupBy("t").agg(F.sum((F.col("y") == 1).cast("long")).alias("p"), F.sum((F.col("y") == 0).cast("long")).alias("n"))
    grid = spark.range(LOW - 1, HIGH + 1).select(F.col("id").cast("int").alias("t")).join(counts, "t", "left").fillna(0, ["p", "n"])
    above, every = Window.orderBy(F.col("t").desc()), Window.partitionBy()
    grid = grid.withColumns({"tp": F.sum("p").over(above), "fp": F.sum("n").over(above), "ap": F.sum("p").over(every), "an": F.sum("n").over(every)}).where(F.col("t") >= LOW)
    scored = _scores(grid.select((F.col("t") / 100).alias("threshold"), "tp", "fp", (F.col("ap") - F.col("tp")).alias("fn"), (F.col("an") - F.col("fp")).alias("tn")))
    return scored


def best_threshold(sweep: DataFrame) -> DataFrame:
    """By f1, then precision, then recall, then the lowest threshold."""
    return sweep.orderBy(F.desc("f1"), F.desc("precision"), F.desc("recall"), "threshold").limit(1)


def class_report(df: DataFrame, label: Column, predicted: Column, classes: list) -> DataFrame:
    """precision, recall, f1 and support of each class, and of `macro avg` and `weighted avg`."""
    pairs = df.select(label.cast("string").alias("y"), predicted.cast("string").alias("z")).groupBy("y", "z").agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.createDataFrame([(str(c),) for c in classes], "class string")
    of = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("double")
    rows = grid.join(pairs, (F.col("class") == F.col("y")) | (F.col("class") == F.col("z")), "left").groupBy("class").agg(of((F.col("class") == F.col("y")) & (F.col("y") == F.col("z"))).alias("tp"), of(F.col("class") == F.col("z")).alias("pp"), of(F.col("class") == F.col("y")).alias("support"))
    p, r = _over(F.col("tp"), F.col("pp")), _over(F.col("tp"), F.col("support"))
    rows = rows.select("class", p.alias("precision"), r.alias("recall"), _over(2 * F.col("tp"), F.col("pp") + F.col("support")).alias("f1"), F.col("support").cast("long").alias("support"))
    wide = lambda c: _over(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    macro = rows.agg(F.lit("macro avg").alias("class"), F.avg("precision"), F.avg("recall"), F.avg("f1"), F.sum("support"))
    weighted = rows.agg(F.lit("weighted avg").alias("class"), wide("precision"), wide("recall"), wide("f1"), F.sum("support"))
    return rows.union(macro).union(weighted)


def macro_f1(report: DataFrame) -> DataFrame:
    """Mean f1 over the classes that labels or predictions have."""
    return report.where(~F.col("class").isin("macro avg", "weighted avg") & ((F.col("support") > 0) | (F.col("precision") > 0))).agg(F.avg("f1").alias("macro_f1"))


def generalisation(valid_f1: Column, test_f1: Column) -> Column:
    drop = valid_f1 - test_f1
    return F.when(drop < 0.05, "good").when(drop < 0.10, "moderate drop").otherwise("possible overfitting")
