"""The pipeline's stages on a small table, and on tables with nulls and without rows."""

import random

import corpus_pipeline
from simforge.llm import toxicity
from simforge.llm.common import cut

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline(spark, tmp_path):
    rng = random.Random(0)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(800)]
    item = " ".join(rng.choices(words, k=40))
    rows, labels = [], []
    for i in range(200):
        w = rng.choices(words, k=60)
        if i % 5 == 0:
            w[3] = "horrible"
            labels.append((i, 1))
        elif i % 2:
            labels.append((i, 0))
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 1))
    rows += [(300, rows[1][1], "en", "s0", 1), (301, rows[2][1] + " more", "en", "s1", 1), (302, "pre " + item + " post", "en", "s2", 1), (303, None, None, None, None), (304, "", "en", None, 0), (None, "just some words here", "en", "s0", 3)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = cut(stage(spark, docs, str(tmp_path)))
        kept.append({r["doc_id"] for r in docs.collect()})
    assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert kept[0] == {r[0] for r in rows} - {i for i in range(0, 200, 5)}
    assert kept[0] - kept[1] == {300, 301, 304} and kept[1] - kept[2] == {302}
    mixed = corpus_pipeline.mix_sources(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} <= kept[2] and len({(r["shard"], r["slot"]) for r in out}) == len(out) == mixed.count()
    assert toxicity.Settings().threshold == 0.7


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
