"""A corpus pipeline of five stages: toxicity, near-duplicates, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs; all but the last return the columns of documents.  run() applies them to the documents table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simforge.llm import decontaminate, minhash, mixing, sharding, toxicity
from simforge.llm.common import cut, fresh, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold.  The classifier learns from all labels whose documents are in docs."""
    columns = docs.columns
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out="toxicity_score").where(F.col("toxicity_score") < model.settings.threshold).select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the first document; of rows equal in id and text, one."""
    columns = docs.columns
    marked = minhash.near_duplicates(docs)
    return marked.where("is_first").dropDuplicates(["doc_id", "text"]).select(*columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    columns = docs.columns
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).where(F.size("item_ids") == 0).select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: each document as often as the mix takes it."""
    columns = docs.columns
    key, size, copies = fresh(docs, "row_key"), fresh(docs, "size"), fresh(docs, "copies")
    # rows equal in id, source and text are interchangeable: their copies are added up and dealt out to one of them
    row = F.md5(F.concat_ws("|", *[F.coalesce(F.md5(F.col(c).cast("string").cast("binary")), F.lit("null")) for c in ("doc_id", "source", "text")]).cast("binary"))
    docs = docs.withColumn(key, row)
    narrow = cut(docs.select(F.col(key).alias("row_key"), "source", mixing.n_words(F.col("text")).alias("size")))
    taken = mixing.mix(narrow, "source", "size", ["row_key"]).where("copies > 0").groupBy(F.col("row_key").alias(key)).agg(F.sum("copies").cast("int").alias(copies))
    joined = docs.dropDuplicates([key]).join(taken, key)
    return joined.withColumn(size, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*columns)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, shard, slot) of each row."""
    narrow = docs.select("doc_id", F.xxhash64("text").alias("code"))
    return sharding.shard(narrow, ["doc_id", "code"]).select("doc_id", F.col("shard").cast("int"), "slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL expresses neither the classifier nor the signatures.
ORACLE_SQL = None
