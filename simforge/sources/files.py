"""Source files as tables."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simforge.functions.lexical import newlines
from simforge.operators.pairs import PAIR_KEY
from simforge.operators.storage import complete, exists

SCORES = ["S_token", "S_AST", "S_PDG", "pdg_valid", "S_structure", "unixcoder_cosine", "unixcoder_l2", "unixcoder_manhattan"]
_KEY = [T.StructField(c, T.StringType(), False) for c in PAIR_KEY]


def pair_schema(*scores: str) -> T.StructType:
    """Explicit schema of a pair table; flags are integers, scores doubles."""
    return T.StructType([*_KEY, *[T.StructField(s, T.IntegerType() if s in ("pdg_valid", "GroundTruth") else T.DoubleType()) for s in scores]])


def source_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("cpp", "c++"), recursive: bool = False) -> DataFrame:
    """(problem, file, code, n_bytes) of root/<problem>/<file>; bytes that are no UTF-8 are dropped, line ends are \\n.

    Files of no bytes, which a scan leaves out, come from the listing that the scan is planned by.
    """
    kinds = ",".join(e.replace("+", "[+]") for e in extensions)
    reader = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{kinds}}}")
    files = reader.option("recursiveFileLookup", "true").load(root) if recursive else reader.load(f"{root.rstrip('/')}/*/*")
    plain = lambda c: F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^([A-Za-z0-9]+:)/+", "$1/")
    scanned = files.select(plain(F.col("path")).alias("path"), newlines(_decoded("content")).alias("code"), F.col("length").alias("n_bytes"))
    listed = spark.createDataFrame([(x,) for x in files.inputFiles()], "path string").select(plain(F.col("path")).alias("path"))
    empty = listed.join(scanned.select("path"), "path", "left_anti").select("path", F.lit("").alias("code"), F.lit(0).cast("long").alias("n_bytes"))
    parts = F.split("path", "/")
    return scanned.unionByName(empty).select(F.element_at(parts, -2).alias("problem"), F.element_at(parts, -1).alias("file"), "code", "n_bytes")


@F.pandas_udf(T.StringType())
def _decode(content: pd.Series) -> pd.Series:
    return content.map(lambda b: bytes(b).decode("utf-8", "ignore"))


def _decoded(col: str):
    """Native where the bytes are valid UTF-8; only other files pass through Python."""
    return F.when(F.is_valid_utf8(F.col(col).cast("string")), F.col(col).cast("string")).otherwise(_decode(F.col(col)))


def ir_files(spark: SparkSession, root: str) -> DataFrame:
    """(problem, stem, ir) of root/<problem>/<stem>.ll."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ll").load(f"{root.rstrip('/')}/*/*")
    parts = F.split("path", "/")
    return files.select(F.url_decode(F.element_at(parts, -2)).alias("problem"), F.url_decode(F.regexp_replace(F.element_at(parts, -1), r"\.ll$", "")).alias("stem"), newlines(_decoded("content")).alias("ir"))


def with_ir(files: DataFrame, irs: DataFrame) -> DataFrame:
    """files with ir, null where there is none."""
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    return files.withColumn("stem", stem).join(irs, ["problem", "stem"], "left").drop("stem")


def fingerprint(files: DataFrame) -> DataFrame:
    """One row: the md5 of "problem/file:size" lines, in order of problem and file.

    One row holds all lines, as the order of the lines is part of the print; caches go by content_key instead.
    """
    line = F.concat("problem", F.lit("/"), "file", F.lit(":"), F.col("n_bytes").cast("string"))
    rows = F.sort_array(F.collect_list(F.struct("problem", "file", line.alias("line"))))
    return files.agg(F.md5(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").cast("binary")).alias("fingerprint"))


def pair_csv(spark: SparkSession, path: str, *scores: str) -> DataFrame:
    return spark.read.schema(pair_schema(*scores)).option("header", "true").csv(path)


def parquet_or_csv(spark: SparkSession, parquet: str, csv: str, schema: T.StructType | None = None) -> DataFrame:
    """The Parquet table if it is there, else the CSV file."""
    if exists(spark, parquet):
        return spark.read.parquet(parquet)
    reader = spark.read.option("header", "true")
    return reader.schema(schema).csv(csv) if schema else reader.option("inferSchema", "true").csv(csv)


def content_key(files: DataFrame) -> str:
    """A key of the files' names, sizes and texts that needs no order: counts and sums of hashes, in one aggregation."""
    of = [F.col(c) for c in ("problem", "file", "n_bytes", "code", "ir") if c in files.columns]
    h = F.xxhash64(*of)
    r = files.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64(h, F.lit(1))).alias("x")).first()
    return hashlib.md5(f"{r['n']}|{r['s']}|{r['x']}".encode()).hexdigest()


def cached(spark: SparkSession, files: DataFrame, root: str, name: str, make) -> DataFrame:
    """make(files) as Parquet under root, kept by the files' content; made again when the files have changed or a job broke off."""
    path = f"{root.rstrip('/')}/{name}-{content_key(files)}"
    if not complete(spark, path):
        make(files).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
