"""A whole training run of the pair classifier: balanced pool, external split, training, evaluation, artifacts."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simforge.operators import features, metrics, mlp, sampling, storage
from simforge.operators.pairs import PAIR_KEY
from simforge.sources import sinks


@dataclass(frozen=True)
class Trained:
    """What scoring needs: the net, the scaler's ranges, the threshold, and what is known of the run."""

    model: mlp.Mlp
    ranges: dict
    threshold: float
    meta: dict


def pool(pairs: DataFrame, most_positives: int = 500_000, ratio: int = 5, seed: int = 42) -> DataFrame:
    """A bounded sample of each label, then at most ratio negatives for a positive."""
    known = features.labelled(features.prepare(pairs))
    sample = sampling.reservoir(known, "GroundTruth", {1: most_positives, 0: most_positives * ratio}, PAIR_KEY, seed)
    return sampling.downsample(sample, "GroundTruth", ratio, PAIR_KEY, seed)


def _arrays(df: DataFrame, ranges: dict) -> tuple[np.ndarray, np.ndarray]:
    names = list(features.FEATURES)
    got = features.scale(df, ranges).select(*names, "GroundTruth").toArrow()
    return np.stack([got.column(c).to_numpy() for c in names], axis=1).astype(float), got.column("GroundTruth").to_numpy()


def evaluate(pairs: DataFrame, trained: Trained, out: str | None = None) -> dict:
    """Scores and counts of the pairs at the threshold; the predictions are written under out."""
    known = features.labelled(features.prepare(pairs))
    scored = mlp.score(features.scale(known, trained.ranges), trained.model, list(features.FEATURES), trained.threshold)
    if out:
        scored.select(*PAIR_KEY, "GroundTruth", "Plagiarism_Probability", "Is_Plagiarized").write.mode("overwrite").parquet(out)
        scored = scored.sparkSession.read.parquet(out)
    return metrics.confusion(scored, F.col("GroundTruth"), F.col("Is_Plagiarized").cast("int")).first().asDict()


def run(spark: SparkSession, pairs: DataFrame, external: DataFrame, out: str, others: dict[str, DataFrame] | None = None, seed: int = 42, most_positives: int = 500_000, **settings) -> Trained:
    """Trains on a balanced pool of pairs and the external set's training part; validates and tests on its other parts and on others.

    The pool and the external set's parts, bounded by most_positives and the external table, go to the driver.  Written under
    out: model, ranges, history, meta, log and the predictions of each evaluation.
    """
    with sinks.Log(f"{out}/session.log") as log:
        sample = pool(pairs, most_positives, seed=seed).select(*PAIR_KEY, "GroundTruth", *features.FEATURES)
        split = storage.saved(sampling.stratified_split(features.labelled(features.prepare(external)), "GroundTruth", PAIR_KEY, seed=seed))
        part = lambda name: split.where(F.col("split") == name).select(*PAIR_KEY, "GroundTruth", *features.FEATURES)
        train = storage.saved(sample.unionByName(part("train")))
        sizes = {name: df.groupBy("GroundTruth").count().collect() for name, df in (("train", train), ("valid", part("valid")), ("test", part("test")))}
        info = {name: {str(r["GroundTruth"]): r["count"] for r in rows} for name, rows in sizes.items()}
        log(f"rows: {info}")
        ranges = features.fit_scaler(train)
        (x, y), (valid_x, valid_y) = _arrays(train, ranges), _arrays(part("valid"), ranges)
        model, threshold, history = mlp.train(x, y, valid_x, valid_y, seed=seed, **settings)
        best = max(history, key=lambda h: h["valid_f1"])
        for h in history:
            log(f"epoch {h['epoch']}: loss {h['train_loss']:.6f}, valid F1 {h['valid_f1']:.4f} at {h['valid_threshold']:.2f}")
        meta = {"feature_cols": list(features.FEATURES), "distance_normalization": "1/(1+d)", "final_feature_normalization": "MinMaxScaler(train_only)->[0,1]", "hyperparameters": {"hidden_dims": list(mlp.LAYERS), **settings}, "best_epoch": best["epoch"], "best_valid_f1": best["valid_f1"], "best_threshold": threshold, "rows": info}
        trained = Trained(model, ranges, threshold, meta)
        for name, df in {"external_test": part("test"), **(others or {})}.items():
            meta[f"{name}_metrics"] = evaluate(df, trained, f"{out}/{name}_predictions")
            log(f"{name}: {meta[f'{name}_metrics']}")
        sinks.write_text(f"{out}/model.json", model.to_json())
        sinks.write_json(f"{out}/ranges.json", ranges)
        sinks.write_json(f"{out}/history.json", history)
        sinks.write_json(f"{out}/meta.json", meta)
    return trained


def load(spark: SparkSession, out: str, otherwise: float = 0.5) -> Trained:
    """A stored run; the threshold is the meta file's, and otherwise where there is none."""
    read = lambda name: storage.read_text(spark, f"{out}/{name}")
    model, ranges, meta = read("model.json"), read("ranges.json"), json.loads(read("meta.json") or "{}")
    if model is None or ranges is None:
        raise FileNotFoundError(f"no model under {out}")
    return Trained(mlp.Mlp.from_json(model), {k: tuple(v) for k, v in json.loads(ranges).items()}, float(meta.get("best_threshold", otherwise)), meta)
