"""Scoring new files against a standing corpus, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from simforge.functions.similarity import set_dice
from simforge.operators.pairs import PAIR_KEY
from simforge.plans.detect import token_fingerprints


def against(new: DataFrame, corpus: DataFrame, least: float) -> DataFrame:
    """Pairs of new files (problem, file, fp) with files of the corpus that share a fingerprint, of Dice at least least."""
    left = new.select(F.col("problem").alias("problem_1"), F.col("file").alias("file_1"), F.col("fp").alias("a"))
    right = corpus.select(F.col("problem").alias("problem_2"), F.col("file").alias("file_2"), F.col("fp").alias("b"))
    hits = left.select("problem_1", "file_1", F.explode("a").alias("h")).join(right.select("problem_2", "file_2", F.explode("b").alias("h")), "h").select(*PAIR_KEY).distinct()
    scored = hits.join(left, ["problem_1", "file_1"]).join(right, ["problem_2", "file_2"])
    return scored.select(*PAIR_KEY, set_dice(F.col("a"), F.col("b")).alias("S_token")).where(F.col("S_token") >= least)


def stream(files: DataFrame, corpus: DataFrame, out: str, checkpoint: str, least: float = 0.5) -> StreamingQuery:
    """Starts a query over a stream of files (problem, file, code); each batch's pairs are written under its own id, so that a repeated batch replaces itself."""

    def batch(df: DataFrame, batch_id: int) -> None:
        against(token_fingerprints(df), corpus, least).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
