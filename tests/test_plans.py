"""A whole run, a stream, and the driver contract."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from simforge.operators import features, mlp
from simforge.plans import detect
from simforge.streaming import score

CODE = "int main(){ int k = 7; double t = 0.25; for(int j=0;j<k;j++){ t += j; } if (t > 3) { k++; } return 0; }"


def test_detection_run(spark, tmp_path):
    rows = [("p", "a.cpp", CODE, None), ("p", "b.cpp", CODE.replace("k", "q"), None), ("q", "c.cpp", "void f(){ while(1){} }", None)]
    files = spark.createDataFrame(rows, "problem string, file string, code string, ir string").withColumn("n_bytes", F.octet_length("code"))
    pairs = detect.pair_features(spark, files, str(tmp_path / "cache"), training=True)
    got = {(r["file_1"], r["file_2"]): r for r in pairs.collect()}
    assert len(got) == 3 and got["a.cpp", "b.cpp"]["S_token"] == 1 and got["a.cpp", "b.cpp"]["S_AST"] == 1
    ranges = features.fit_scaler(features.prepare(pairs))
    import numpy as np

    model = mlp.Mlp((np.array([[4.0]] + [[0.0]] * 7),), (np.array([-2.0]),))
    summary = detect.detect(spark, pairs, model, ranges, str(tmp_path / "out"), threshold=0.5)
    assert summary["predicted_clones"] == 1 and summary["binary_metrics"]["f1"] == 1
    assert json.loads((tmp_path / "out/run_summary.json").read_text())["n_rows"] == 3


def test_stream(spark, tmp_path):
    corpus = detect.token_fingerprints(spark.createDataFrame([("p", "a", CODE)], "problem string, file string, code string"))
    spark.createDataFrame([("n", "x", CODE), ("n", "y", "void f(){}")], "problem string, file string, code string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("problem string, file string, code string").parquet(str(tmp_path / "in"))
    score.stream(stream, corpus, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("file_1", "file_2", "S_token").collect()] == [("x", "a", 1.0)]


QUICK = ["token_fingerprints", "structure_global", "embedding_pairs_same_problem", "feature_prep", "minmax_scale", "stratified_split", "confusion", "threshold_sweep", "class_report", "connected_components", "type_from_filename", "mlp_score_native", "dataset_fingerprint"]


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, name):
    d = "/root/testdata/sf0.001"
    df = __spark_entry__.queries()[name](spark, d)
    con = duckdb.connect()
    for t in ("pages", "embeddings", "labels", "lineitem", "events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    found = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    tidy = lambda rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert sorted(columns) == sorted(df.columns)
    assert tidy(tuple(r) for r in df.select(*columns).collect()) == tidy(found.fetchall())


def test_structure_similarity_pairs_all_files(spark):
    d = "/root/testdata/sf0.001"
    queries = __spark_entry__.queries()
    got, own = queries["structure_similarity"](spark, d), queries["structure_similarity_same_problem"](spark, d)
    n = spark.read.parquet(f"{d}/pages.parquet").count()
    assert got.count() == n * (n - 1) // 2
    assert own.count() == own.join(got.where("problem_1 = problem_2"), own.columns).count() == got.where("problem_1 = problem_2").count()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
