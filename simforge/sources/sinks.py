"""Where results go: pair tables, predictions, reports, summaries."""

from __future__ import annotations

import json
from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simforge.operators import storage
from simforge.operators.pairs import PAIR_KEY

ZONE = "Asia/Kolkata"


def run_label(name: str, now: datetime | None = None) -> str:
    return f"{name}_{(now or datetime.now(ZoneInfo(ZONE))).strftime('%Y-%m-%d_%H-%M-%S')}"


def write_pairs(pairs: DataFrame, path: str, places: int | None = None, form: str = "csv") -> None:
    """A pair table in order of its key; doubles rounded to places, if given."""
    if places is not None:
        pairs = pairs.withColumns({c: F.round(c, places) for c, t in pairs.dtypes if t == "double"})
    writer = pairs.sortWithinPartitions(*[c for c in PAIR_KEY if c in pairs.columns]).write.mode("overwrite")
    writer.option("header", "true").csv(path) if form == "csv" else writer.parquet(path)


def write_predictions(scored: DataFrame, path: str) -> None:
    write_pairs(scored.select(*PAIR_KEY, F.col("Plagiarism_Probability").cast("float").alias("Plagiarism_Probability"), "Is_Plagiarized", "Predicted_Type"), path)


def metrics_text(metrics: dict, report: list[dict] | None = None) -> str:
    lines = [f"{k:<12} {v:.6f}" if isinstance(v, float) else f"{k:<12} {v}" for k, v in metrics.items()]
    if report:
        lines += ["", "class          precision  recall     f1         support"]
        lines += [f"{r['class']:<14} {r['precision']:<10.4f} {r['recall']:<10.4f} {r['f1']:<10.4f} {r['support']}" for r in report]
    return "\n".join(lines) + "\n"


def write_text(path: str, text: str) -> None:
    """A text file in the file system that the path names."""
    storage.write_text(SparkSession.active(), path, text)


def write_json(path: str, value) -> None:
    write_text(path, json.dumps(value, indent=2, default=str))


class Log:
    """Lines with times, kept and written as one text; a run that is broken off still writes what it has."""

    def __init__(self, path: str):
        self.path, self.lines = path, []

    def __call__(self, text: str) -> None:
        self.lines.append(f"{datetime.now(ZoneInfo(ZONE)):%Y-%m-%d %H:%M:%S} | {text}")

    def __enter__(self) -> Log:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if error is not None:
            self(f"stopped: {kind.__name__}: {error}")
        write_text(self.path, "\n".join(self.lines) + "\n")


def run_summary(scored: DataFrame, threshold: float, cluster_threshold: float, metrics: dict, outputs: dict, **names) -> dict:
    """What a run was and gave, with the distribution of predicted types."""
    r = scored.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("Is_Plagiarized").cast("long")), F.lit(0)).alias("p")).first()
    types = {x["Predicted_Type"]: x["count"] for x in scored.groupBy("Predicted_Type").count().collect()}
    return {"timestamp": datetime.now(ZoneInfo(ZONE)).isoformat(), **names, "threshold": threshold, "cluster_threshold": cluster_threshold, "n_rows": r["n"], "predicted_clones": r["p"], "predicted_clone_rate": r["p"] / r["n"] if r["n"] else 0.0, "clone_type_distribution": types, "binary_metrics": metrics, "outputs": outputs}
