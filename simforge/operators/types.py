"""Clone types: training pairs by file names, a search over tree ensembles, predictions on positive pairs."""

from __future__ import annotations

import json
import math
import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simforge.functions import lexical
from simforge.operators import metrics, sampling, storage
from simforge.operators.pairs import PAIR_KEY


def typed_pairs(pairs: DataFrame) -> DataFrame:
    """Positive pairs inside a problem one of whose files is s1, with the other's clone_type."""
    a, b = lexical.stem(F.col("file_1")), lexical.stem(F.col("file_2"))
    other = F.when(a == "s1", lexical.type_of_file(F.col("file_2"))).when(b == "s1", lexical.type_of_file(F.col("file_1")))
    return pairs.where((F.col("problem_1") == F.col("problem_2")) & (F.col("GroundTruth") == 1)).withColumn("clone_type", other).where("clone_type is not null")


#: Settings drawn of each kind at most.
MOST = 200


def grid(most: int = MOST, seed: int = 42) -> list[tuple[str, dict]]:
    """Single trees, forests, and forests of nearly random trees (one feature per split, all rows), which stand for extremely randomised trees.

    The whole grid of depths, leaf sizes, impurities, class weights and numbers of trees, or of a kind with more settings than
    most a seeded draw.  A least size of nodes that are split has no counterpart here: leaf sizes bound it.
    """
    rng = random.Random(seed)
    common = [{"maxDepth": d, "minInstancesPerNode": k, "impurity": i, "balanced": b} for d in (3, 4, 5, 6, 7, 30) for k in (1, 2, 3, 5) for i in ("gini", "entropy") for b in (False, True)]
    deep = [c for c in common if c["maxDepth"] in (4, 5, 6, 30)]
    kinds = {
        "tree": common,
        "forest": [{**c, "numTrees": n, "featureSubsetStrategy": "sqrt"} for n in (100, 200, 300) for c in deep],
        "random_trees": [{**c, "numTrees": n, "featureSubsetStrategy": "1", "subsamplingRate": 1.0} for n in (100, 200, 300) for c in deep],
    }
    return [(kind, c) for kind, choices in kinds.items() for c in (choices if len(choices) <= most else rng.sample(choices, most))]


def _pipeline(kind: str, params: dict, features: list[str], seed: int) -> Pipeline:
    params = dict(params)
    common = {"featuresCol": "x", "labelCol": "y", "predictionCol": "p", "seed": seed}
    if params.pop("balanced", False):
        common["weightCol"] = "class_weight"
    trees = DecisionTreeClassifier(**common, **params) if kind == "tree" else RandomForestClassifier(**common, **params)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), MinMaxScaler(inputCol="raw", outputCol="x"), trees])


def _weighted(df: DataFrame) -> DataFrame:
    """df with class_weight, the inverse of the class's share among the classes."""
    sizes = {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}  # one row for each class
    weight = F.lit(1.0)
    for y, n in sizes.items():
        weight = F.when(F.col("y") == y, sum(sizes.values()) / (len(sizes) * n)).otherwise(weight)
    return df.withColumn("class_weight", weight)


def search(pairs: DataFrame, features: list[str], choices: list | None = None, folds: int = 5, seed: int = 42) -> list[dict]:
    """Mean and deviation of macro-F1 over stratified folds of each choice, best first; the scaler is fitted inside each fold."""
    df = sampling.stratified_folds(pairs.withColumn("y", F.col("clone_type") - 1.0), "clone_type", PAIR_KEY, folds, seed).cache()
    rows = []
    for kind, params in choices or grid():
        f1 = []
        for k in range(folds):
            done = _pipeline(kind, params, features, seed).fit(_weighted(df.where(F.col("fold") != k))).transform(df.where(F.col("fold") == k))
            labels = [r[0] for r in done.select("y").distinct().collect()]
            f1.append(sum(MulticlassClassificationEvaluator(labelCol="y", predictionCol="p", metricName="fMeasureByLabel", metricLabel=y).evaluate(done) for y in labels) / max(1, len(labels)))
        mean = sum(f1) / folds
        rows.append({"model": kind, **params, "cv_f1_macro_mean": mean, "cv_f1_macro_std": math.sqrt(sum((x - mean) ** 2 for x in f1) / folds), "params": params})
    df.unpersist()
    return sorted(rows, key=lambda r: (-r["cv_f1_macro_mean"], r["cv_f1_macro_std"]))


def refit(pairs: DataFrame, features: list[str], best: dict, seed: int = 42) -> PipelineModel:
    return _pipeline(best["model"], best["params"], features, seed).fit(_weighted(pairs.withColumn("y", F.col("clone_type") - 1.0)))


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist()), key=lambda x: -x[1])


def rules(model: PipelineModel) -> str:
    return model.stages[-1].toDebugString


def predict(pairs: DataFrame, model: PipelineModel) -> DataFrame:
    """pairs with Predicted_Type: the model's on positive pairs, Not-Clone on the others."""
    done = model.transform(pairs).withColumn("Predicted_Type", F.when(F.col("Is_Plagiarized"), lexical.type_name((F.col("p") + 1).cast("int"))).otherwise("Not-Clone"))
    return done.select(*pairs.columns, "Predicted_Type")


def write_search(spark: SparkSession, rows: list[dict], model: PipelineModel, pairs: DataFrame, features: list[str], out: str) -> dict:
    """The search's outputs under out: all settings, the best one with its in-sample scores, the pairs with both types, the model."""
    storage.write_text(spark, f"{out}/type_search.json", json.dumps([{k: v for k, v in r.items() if k != "params"} for r in rows], indent=2))
    done = model.transform(pairs.withColumn("y", F.col("clone_type") - 1.0)).withColumn("pred_type", (F.col("p") + 1).cast("int"))
    name = lambda c: lexical.type_name(F.col(c))
    typed = done.select(*PAIR_KEY, "clone_type", name("clone_type").alias("true_type_label"), "pred_type", name("pred_type").alias("pred_type_label"), *features)
    typed.write.mode("overwrite").option("header", "true").csv(f"{out}/type_pairs")
    report = [r.asDict() for r in metrics.class_report(done, F.col("clone_type"), F.col("pred_type"), [1, 2, 3, 4]).collect()]
    best = {"type": "clone_type_search", "best_model": rows[0]["model"], "best_params": rows[0]["params"], "cv_f1_macro_mean": round(rows[0]["cv_f1_macro_mean"], 4), "cv_f1_macro_std": round(rows[0]["cv_f1_macro_std"], 4), "in_sample": report, "importances": importances(model, features), "features": features}
    storage.write_text(spark, f"{out}/type_best.json", json.dumps(best, indent=2))
    storage.write_text(spark, f"{out}/type_rules.txt", rules(model))
    model.write().overwrite().save(f"{out}/type_model")
    return best
