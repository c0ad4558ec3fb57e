"""Operators on small tables."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from simforge.operators import ast, cluster, embed, features, metrics, mlp, pairs, pdg, sampling, types
from simforge.sources import files as sources
from simforge.sources import sinks


def test_triangle(spark):
    names = [("p1", "s10"), ("p10", "s1"), ("p10", "s2"), ("p2", "a"), ("p1", "s2")]
    df = spark.createDataFrame(names, "problem string, file string")
    want = {(*a, *b) for a, b in itertools.combinations(sorted(names), 2)}
    for blocks in (1, 3):
        got = [tuple(r) for r in pairs.triangle(df, blocks).select(*pairs.PAIR_KEY).collect()]
        assert len(got) == len(want) and set(got) == want
    assert pairs.triangle(df, same_problem=True).count() == 2


def test_shared_measures(spark):
    bags = spark.createDataFrame([("p", "a", "x", 2), ("p", "a", "y", 1), ("p", "b", "x", 1), ("p", "b", "z", 4), ("p", "c", "q", 1)], "problem string, file string, key string, w int")
    (r,) = pairs.shared_dice(bags, "d").collect()
    assert r["d"] == 2 * 1 / (3 + 5)
    (r,) = pairs.shared_cosine(bags, "d").collect()
    assert r["d"] == pytest.approx(2 / math.sqrt(5 * 17))


def test_combine_reports_lost_pairs(spark):
    a = spark.createDataFrame([("p", "a", "p", "b", 1.0), ("p", "a", "p", "c", 1.0)], "problem_1 string, file_1 string, problem_2 string, file_2 string, x double")
    b = a.where("file_2 = 'b'").withColumnRenamed("x", "y")
    assert pairs.combine([a, b]).count() == 1
    assert {tuple(r) for r in pairs.lost_pairs([a, b]).collect()} == {(0, 1), (1, 0)}
    assert pairs.label_by_problem(a).columns[4] == "GroundTruth"


def test_tree_bags_agree(spark):
    code = "f(a, 1) { g[2]; (b) } /* c */ 'x'"
    df = spark.createDataFrame([("p", "a", code), ("p", "b", "f(b, 2) { (c) g[3]; } /* d */ 'y'"), ("p", "e", "")], "problem string, file string, code string")
    native = {(r["file"], r["key"]): r["w"] for r in ast.subtree_bags(ast.parse(df)).collect()}
    assert native == {(r["file"], r["key"]): r["w"] for r in ast.tree_bags(df).collect()}
    got = {(r["file_1"], r["file_2"]): r["S_AST"] for r in ast.similarity(ast.tree_bags(df)).collect()}
    assert 0.5 < got["a", "b"] <= 1


IR = """define i32 @main() {
entry:
  %x = alloca i32
  %y = load i32, ptr %x ; c
  store i32 %y, ptr %x
  br i1 %c, label %then, label %else
then:                ; preds = %entry
  %z = add i32 %y, %y
  call void @f(i32 %z)
  br label %else
else:
  %p = phi i32 [ %z, %then ]
  ret i32 %p
}
"""


def test_pdg(spark):
    irs = spark.createDataFrame([("p", "a", IR), ("p", "b", "; STUB_IR_FAILED\nx:\n"), ("p", "c", None)], "problem string, file string, ir string")
    nodes, edges = pdg.graph(irs)
    labels = {r["node"]: r["label"] for r in nodes.collect()}
    call = next(n for n in labels if n.startswith("call_"))
    assert labels == {"entry": "block", "then": "block", "else": "block", "%x": "alloca", "%y": "load", "%z": "arith", "%p": "phi", "%then": "inst", call: "call"}
    got = {(r["src"], r["dst"]): r["etype"] for r in edges.collect()}
    assert got == {("entry", "then"): "control", ("entry", "else"): "control", ("then", "else"): "control", ("then", call): "control", ("%x", "%y"): "data", ("%y", "%x"): "data", ("%y", "%z"): "data", ("%z", call): "data", ("%z", "%p"): "data", ("%then", "%p"): "data"}
    histogram = pdg.histogram(pdg.refine(nodes, edges))
    assert histogram.agg(F.sum("w")).first()[0] == 3 * len(labels)
    valid = irs.select("problem", "file", pdg.valid(F.col("ir")).alias("valid"))
    rows = {(r["file_1"], r["file_2"]): (r["S_PDG"], r["pdg_valid"]) for r in pdg.similarity(valid, histogram).collect()}
    assert rows == {("a", "b"): (0.0, 0), ("a", "c"): (0.0, 0), ("b", "c"): (0.0, 0)}


def test_wl_counts_self_loops_twice(spark):
    nodes = spark.createDataFrame([("p", "f", "a", "x"), ("p", "f", "b", "x")], "problem string, file string, node string, label string")
    edges = spark.createDataFrame([("p", "f", "a", "a", "data")], "problem string, file string, src string, dst string, etype string")
    labels = Counter({r["label"]: r["n"] for r in pdg.refine(nodes, edges, 0).collect()})
    assert labels == {"x_deg2": 1, "x_deg0": 1}


def test_features(spark):
    df = spark.createDataFrame([("NaN", "3"), ("Infinity", "-1"), (None, "x"), ("1.5", "0"), ("0.25", "1")], "s string, d string")
    got = [tuple(r) for r in features.prepare(df, ("s", "d"), ("d",)).collect()]
    assert got == [(0, 0.25), (0, 1), (0, 1), (1, 1), (0.25, 0.5)]
    nums = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    ranges = features.fit_scaler(nums, ["a", "b"])
    assert [tuple(r) for r in features.scale(nums, ranges).collect()] == [(0, 0), (1, 0)]
    with pytest.raises(ValueError):
        features.labelled(nums)


def test_metrics(spark):
    rows = [(1, 1)] * 568 + [(0, 1)] * 2 + [(1, 0)] * 88 + [(0, 0)] * 2016
    df = spark.createDataFrame(rows, "y int, z int")
    r = metrics.confusion(df, F.col("y"), F.col("z")).first()
    assert (r["f1"], r["precision"], r["recall"]) == pytest.approx((0.9265905383360522, 0.9964912280701754, 0.8658536585365854))
    empty = metrics.confusion(df.where("y > 5"), F.col("y"), F.col("z")).first()
    assert (empty["tp"], empty["f1"], empty["accuracy"]) == (0, 0, 0)


def test_threshold_sweep_matches_plain_counts(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 200)
    p = np.round(np.clip(y * 0.3 + rng.random(200) * 0.7, 0, 1), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    for r in metrics.threshold_sweep(df, F.col("y"), F.col("p")).collect():
        z = p >= r["threshold"]
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == ((z & (y == 1)).sum(), (z & (y == 0)).sum(), (~z & (y == 1)).sum(), (~z & (y == 0)).sum())
    best = metrics.best_threshold(metrics.threshold_sweep(df, F.col("y"), F.col("p"))).first()
    assert (best["f1"], best["threshold"]) == pytest.approx(mlp.best_f1(p, y))


def test_samples(spark):
    df = spark.range(100).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    assert {r["y"]: r["count"] for r in sampling.reservoir(df, "y", {1: 5, 0: 7}, ["id"]).groupBy("y").count().collect()} == {1: 5, 0: 7}
    assert sampling.downsample(df, "y", 2, ["id"]).count() == 75
    split = {tuple(r[:2]): r[2] for r in sampling.stratified_split(df, "y", ["id"]).groupBy("y", "split").count().collect()}
    assert split == {(1, "test"): 5, (1, "valid"): 4, (1, "train"): 16, (0, "test"): 15, (0, "valid"): 12, (0, "train"): 48}
    folds = [r[2] for r in sampling.stratified_folds(df, "y", ["id"]).groupBy("y", "fold").count().collect()]
    assert sorted(folds) == [5] * 5 + [15] * 5
    assert [r["id"] for r in sampling.shuffled(df, ["id"]).collect()] == [r["id"] for r in sampling.shuffled(df.repartition(3), ["id"]).collect()]


def test_clusters(spark):
    rows = [("p", "a", "p", "b", 0.99, "Type-1"), ("p", "b", "p", "c", 0.98, "Type-2"), ("p", "a", "p", "c", 0.1, "Not-Clone"), ("p", "a", "p", "d", 0.1, "Not-Clone"), ("p", "a", "q", "x", 0.99, "Type-1")]
    df = spark.createDataFrame(rows, "problem_1 string, file_1 string, problem_2 string, file_2 string, Plagiarism_Probability double, Predicted_Type string")
    got = [r.asDict() for r in cluster.report(df, 0.97).orderBy("Cluster_ID").collect()]
    assert got[0] == {"Problem": "p", "Cluster_ID": 1, "Cluster_Size": 3, "Files": "a, b, c", "Pair_Relationships": "a - b (Type-1, 0.99) | b - c (Type-2, 0.98)", "Avg_Probability": 0.985, "Graph_Density": 0.667, "Confidence": "MEDIUM"}
    assert got[1]["Confidence"].startswith("UNIQUE") and len(got) == 2
    assert cluster.cluster_threshold(0.87) == pytest.approx(0.97) and cluster.cluster_threshold(0.1) == 0.30


def test_components_of_a_path(spark):
    v = spark.createDataFrame([("p", f"{i:02d}") for i in range(20)], "problem string, file string")
    e = spark.createDataFrame([("p", f"{i:02d}", f"{i + 1:02d}") for i in range(18)], "problem string, a string, b string")
    assert Counter(r["root"] for r in cluster.components(v, e).collect()) == {"00": 19, "19": 1}


def test_embeddings(spark):
    df = spark.createDataFrame([("p", "a", "int x = 1;"), ("p", "b", "int y = 2;"), ("p", "c", " ".join(["w%d" % i for i in range(1200)])), ("q", "d", "")], "problem string, file string, code string")
    v = embed.embeddings(df).cache()
    norms = {r["file"]: np.linalg.norm(r["v"]) for r in v.collect()}
    assert norms["a"] == pytest.approx(1, abs=1e-5) and norms["d"] == 0
    whole = {tuple(r[:4]): r[4:] for r in embed.pair_measures(v, 2).collect()}
    assert len(whole) == 6
    for r in embed.same_problem_measures(v).collect():
        assert whole[tuple(r[:4])] == pytest.approx(r[4:], abs=1e-9)


def test_mlp(spark):
    rng = np.random.default_rng(1)
    x = rng.random((600, 8))
    y = (x[:, 0] + x[:, 1] > 1).astype(int)
    model, threshold, history = mlp.train(x[:400], y[:400], x[400:], y[400:], epochs=60, batch=64, rate=5e-3, dropout=0.1, pos_weight=1.0, alpha=0.5)
    assert max(h["valid_f1"] for h in history) > 0.85 and 0.3 <= threshold <= 0.95
    again = mlp.Mlp.from_json(model.to_json())
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:20]], ", ".join(f"x{i} double" for i in range(8)))
    cols = [f"x{i}" for i in range(8)]
    got = [r["Plagiarism_Probability"] for r in mlp.score(df, again, cols, threshold).collect()]
    native = [r["p"] for r in df.select(mlp.expression(again, [F.col(c) for c in cols]).alias("p")).collect()]
    assert got == pytest.approx(list(model.probability(x[:20]))) and native == pytest.approx(got)


def test_focal_gradient():
    z, y = np.array([0.3, -1.2, 2.0]), np.array([1, 0, 0])
    _, g = mlp.focal_gradient(z, y, 3.0, 2.0, 0.25)
    for i in range(3):
        d = np.zeros(3)
        d[i] = 1e-6
        numeric = (mlp.focal_gradient(z + d, y, 3.0, 2.0, 0.25)[0] - mlp.focal_gradient(z - d, y, 3.0, 2.0, 0.25)[0]) / 2e-6
        assert g[i] == pytest.approx(numeric, rel=1e-4)


def test_type_search(spark):
    rng = np.random.default_rng(2)
    rows = [("p", "s1.cpp", "p", f"s{10 * k + i}.cpp", 1, float(k) + float(rng.normal(0, 0.2)), float(rng.random())) for k in range(1, 5) for i in range(10)]
    df = spark.createDataFrame(rows, "problem_1 string, file_1 string, problem_2 string, file_2 string, GroundTruth int, a double, b double")
    typed = types.typed_pairs(df)
    assert {r[0]: r[1] for r in typed.groupBy("clone_type").count().collect()} == {1: 10, 2: 10, 3: 10, 4: 10}
    best = types.search(typed, ["a", "b"], [("tree", {"maxDepth": 3}), ("forest", {"maxDepth": 3, "numTrees": 5})], folds=2)
    assert best[0]["cv_f1_macro_mean"] >= best[1]["cv_f1_macro_mean"] > 0.5
    model = types.refit(typed, ["a", "b"], best[0])
    assert types.importances(model, ["a", "b"])[0][0] == "a" and "If" in types.rules(model)
    done = types.predict(df.withColumn("Is_Plagiarized", F.col("a") > 2), model)
    assert done.where("Predicted_Type = 'Not-Clone'").count() == df.where("a <= 2").count()


def test_files_and_fingerprint(spark, tmp_path):
    for p, f, b in (("p2", "b.cpp", b"x\r\ny"), ("p1", "a c.cpp", b"caf\xff\xc3\xa9"), ("p1", "d.c++", b"z"), ("p1", "skip.txt", b"no")):
        (tmp_path / p).mkdir(exist_ok=True)
        (tmp_path / p / f).write_bytes(b)
    got = sources.source_files(spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {("p2", "b.cpp", "x\ny", 4), ("p1", "a c.cpp", "café", 6), ("p1", "d.c++", "z", 1)}
    (tmp_path / "p2" / "e 1+2.cpp").write_bytes(b"")
    assert {tuple(r) for r in sources.source_files(spark, str(tmp_path)).where("n_bytes = 0").collect()} == {("p2", "e 1+2.cpp", "", 0)}
    (tmp_path / "p2" / "e 1+2.cpp").unlink()
    import hashlib

    text = "p1/a c.cpp:6\np1/d.c++:1\np2/b.cpp:4"
    assert sources.fingerprint(got).first()[0] == hashlib.md5(text.encode()).hexdigest()
    made = []
    for _ in range(2):
        assert sources.cached(spark, got, str(tmp_path / "cache"), "n", lambda f: (made.append(1), f.select("file"))[1]).count() == 3
    assert len(made) == 1
    (next((tmp_path / "cache").glob("n-*")) / "_SUCCESS").unlink()  # a job that broke off
    sources.cached(spark, got, str(tmp_path / "cache"), "n", lambda f: (made.append(1), f.select("file"))[1])
    assert len(made) == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("p", "a", "p", "b", 0.123456)], "problem_1 string, file_1 string, problem_2 string, file_2 string, S_AST double")
    sinks.write_pairs(df, str(tmp_path / "x"), places=4)
    assert sources.pair_csv(spark, str(tmp_path / "x"), "S_AST").first()["S_AST"] == 0.1235
    assert sources.parquet_or_csv(spark, str(tmp_path / "none"), str(tmp_path / "x"), sources.pair_schema("S_AST")).count() == 1
    assert "f1" in sinks.metrics_text({"f1": 0.5}, [{"class": "0", "precision": 1.0, "recall": 1.0, "f1": 1.0, "support": 2}])


def test_squares_of_bags_match_plain_pairs(spark):
    """Small blocks, a large problem, files without a bag, repeated weights."""
    import random

    rng = random.Random(5)
    bags = {(p, f"f{i}"): {f"k{rng.randrange(12)}": rng.randint(1, 4) for _ in range(rng.randint(0, 9))} for p, n in (("p", 14), ("q", 3)) for i in range(n)}
    files = spark.createDataFrame(list(bags), "problem string, file string")
    rows = spark.createDataFrame([(p, f, k, w) for (p, f), b in bags.items() for k, w in b.items()], "problem string, file string, key string, w long")

    def dice(a, b):
        total = sum(a.values()) + sum(b.values())
        return 2 * sum(min(a[k], b[k]) for k in a.keys() & b.keys()) / total if total else 0.0

    def cosine(a, b):
        norm = (sum(x * x for x in a.values()) * sum(x * x for x in b.values())) ** 0.5
        return sum(a[k] * b[k] for k in a.keys() & b.keys()) / norm if norm else 0.0

    keys = sorted(bags)
    for made, measure in ((pairs.bag_dice, dice), (pairs.bag_cosine, cosine)):
        for same in (False, True):
            got = {tuple(r)[:4]: r["s"] for r in made(rows, "s", files, same, 4).collect()}
            want = {(*x, *y): measure(bags[x], bags[y]) for x in keys for y in keys if x < y and (not same or x[0] == y[0])}
            assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert all(r["s"] > 0 for r in pairs.shared_dice(rows, "s").collect())


def test_ranks_of_hot_labels_match_plain_ranks(spark):
    import hashlib

    rows = [(i, 0 if i % 50 else 1) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, y int").repartition(5)
    order = {y: sorted((i for i, z in rows if z == y), key=lambda i: (hashlib.md5(f"42|{i}".encode()).hexdigest(), i)) for y in (0, 1)}
    assert {r["id"] for r in sampling.reservoir(df, "y", {1: 5, 0: 30}, ["id"]).collect()} == {*order[1][:5], *order[0][:30]}
    assert {r["id"] for r in sampling.downsample(df, "y", 3, ["id"]).collect()} == {*order[1], *order[0][:54]}
    folds = {r["id"]: r["fold"] for r in sampling.stratified_folds(df, "y", ["id"]).collect()}
    assert folds == {i: k % 5 for y in (0, 1) for k, i in enumerate(order[y])}
    assert {r["y"]: r["weight"] for r in sampling.class_weights(df, "y").collect()} == {1: 1 / 18, 0: 1 / 882}


def test_training_run(spark, tmp_path):
    from simforge.plans import training

    rng = np.random.default_rng(4)
    names = list(features.FEATURES)

    def table(n, tag):
        rows = []
        for i in range(n):
            y = int(i % 5 == 0)
            rows.append((f"{tag}{i % 3}", f"a{i}", f"{tag}{i % 3}", f"b{i}", y, *[float(np.clip(0.7 * y + rng.normal(0.15, 0.1), 0, 1)) for _ in names]))
        return spark.createDataFrame(rows, "problem_1 string, file_1 string, problem_2 string, file_2 string, GroundTruth int, " + ", ".join(f"{c} double" for c in names))

    out = str(tmp_path / "run")
    done = training.run(spark, table(300, "p"), table(200, "q"), out, {"other": table(60, "r")}, most_positives=40, epochs=25, batch=32, rate=5e-3, dropout=0.1, pos_weight=1.0, alpha=0.5)
    assert done.meta["rows"]["train"]["1"] == 40 + 25 and done.meta["other_metrics"]["f1"] > 0.8
    again = training.load(spark, out)
    assert again.threshold == done.threshold and training.evaluate(table(60, "r"), again).keys() >= {"f1", "tp"}
    history = __import__("json").loads((tmp_path / "run" / "history.json").read_text())
    assert {"epoch", "train_loss", "valid_f1", "valid_precision", "valid_recall", "valid_threshold", "valid_tp", "valid_fp", "valid_fn", "valid_tn"} == set(history[0])
    assert "epoch 1" in (tmp_path / "run" / "session.log").read_text()


def test_type_grid_and_outputs(spark, tmp_path):
    sizes = {k: sum(kind == k for kind, _ in types.grid()) for k in ("tree", "forest", "random_trees")}
    assert sizes == {"tree": 96, "forest": 192, "random_trees": 192} and len(types.grid(10)) == 30
    rows = [("p", "s1.cpp", "p", f"s{10 * k + i}.cpp", 1, k, float(k), float(i)) for k in range(1, 5) for i in range(10)]
    df = spark.createDataFrame(rows, "problem_1 string, file_1 string, problem_2 string, file_2 string, GroundTruth int, clone_type int, a double, b double")
    best = types.search(df, ["a", "b"], [("tree", {"maxDepth": 4, "balanced": True})], folds=2)
    done = types.write_search(spark, best, types.refit(df, ["a", "b"], best[0]), df, ["a", "b"], str(tmp_path / "t"))
    assert done["cv_f1_macro_mean"] == 1 and spark.read.option("header", "true").csv(str(tmp_path / "t" / "type_pairs")).where("true_type_label = pred_type_label").count() == 40


def test_squares_send_a_file_to_few_blocks(spark):
    """Rows that reach the squares: 16 a file, whatever their number, and not one for each 512 files."""
    n = 9000
    rows = spark.range(n).select(F.lit("p").alias("problem"), F.col("id").cast("string").alias("file"))

    def measure(t, left, right):
        def tile(x, y):
            out = np.zeros((len(left[x]), len(right[y])))
            if x.start == y.start == 0:
                out[0, -1] = t.num_rows
            return [out]

        return tile

    for same in (False, True):
        sent = pairs.squares(rows, measure, ["sent"], same, only="sent").agg(F.sum("sent")).first()[0]
        assert sent == 16 * n


def test_rounding_is_that_of_sql(spark):
    assert pairs.rounded(np.array([0.0009765625, -0.0009765625, 0.25, -1e-12]), 9).tolist() == [0.000976563, -0.000976563, 0.25, 0.0]


def test_graphs_are_made_where_the_text_is(spark):
    """A file's lines are neither shuffled nor sorted; later definitions and earlier uses keep their places."""
    irs = spark.createDataFrame([("p", "a", "e:\n %x = add i32 %y, 1\n %y = load i32 %x\n %y = phi i32 %x\n")], "problem string, file string, ir string")
    nodes, edges = pdg.graph(irs)
    for df in (nodes, edges):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan
    assert {r["node"]: r["label"] for r in nodes.collect()} == {"e": "block", "%x": "arith", "%y": "phi"}
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {("%y", "%x"), ("%x", "%y")}


def test_combined_squares_join_below_the_pairs(spark):
    """The same rows as combine(), files of one table alone left out, and no join or exchange of pairs."""
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([("p", f"f{i}", rng.random(4).tolist()) for i in range(7)], "problem string, file string, v array<double>")
    few = v.where("file <> 'f3'")
    got = pairs.combined_squares([(v, embed._cosines, ["cosine"]), (few, embed._distances, ["l2", "l1"])], block_rows=2)
    want = pairs.combine([embed.pair_measures(v).select(*pairs.PAIR_KEY, "unixcoder_cosine"), embed.pair_measures(few).select(*pairs.PAIR_KEY, "unixcoder_l2", "unixcoder_manhattan")])
    assert got.count() == 15 and {tuple(r)[:4]: pytest.approx(tuple(r)[4:]) for r in want.collect()} == {tuple(r)[:4]: tuple(r)[4:] for r in got.collect()}
    assert "problem_2" not in got._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[1].split("\n", 1)[1]


def test_token_pairs_are_squares(spark):
    from simforge.plans import detect

    fp = spark.createDataFrame([("p", "a", [1, 2, 3]), ("p", "b", [2, 3, 4, 5]), ("q", "c", []), ("q", "d", None)], "problem string, file string, fp array<bigint>")
    df = detect.token_similarity(fp)
    assert "FlatMapGroupsInArrow" in df._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["file_1"], r["file_2"]): r["S_token"] for r in df.collect()}
    assert len(got) == 6 and got["a", "b"] == pytest.approx(4 / 7) and got["a", "c"] == got["c", "d"] == 0


def test_files_alike_meet_in_one_square(spark):
    """Each two values of alike meet in one square; the files of a value that most have are in many blocks, and all pairs are there."""
    n = 6000
    rows = spark.range(n).select(F.lit("p").alias("problem"), F.col("id").cast("string").alias("file"), F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 499 + 1).alias("kind"))

    def measure(t, left, right):
        kind = t.column("kind").to_numpy()
        first = [int(t.column("file")[int(side[0])].as_py()) for side in (left, right)]
        square = float(first[0] * n + first[1])
        return lambda x, y: [np.full((len(left[x]), len(right[y])), square), np.broadcast_to(kind[left[x]][:, None], (len(left[x]), len(right[y]))), np.broadcast_to(kind[right[y]][None], (len(left[x]), len(right[y])))]

    for same in (False, True):
        got = pairs.squares(rows, measure, ["square", "k", "l"], same, alike=F.xxhash64("kind"))
        met = got.groupBy(F.least("k", "l").alias("k"), F.greatest("k", "l").alias("l")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("square").alias("squares")).collect()
        assert sum(r["n"] for r in met) == n * (n - 1) // 2
        assert all(r["squares"] == 1 for r in met if r["k"] > 0)
        assert max(r["squares"] for r in met if r["k"] == r["l"] == 0) > 50


def test_squares_fetch_their_blocks(spark):
    """All pairs of vectors: no file is copied for each square; rows are those of plain pairs, and none of no or one vector."""
    import itertools

    n, rng = 600, np.random.default_rng(7)
    values = rng.random((n, 64))
    v = spark.createDataFrame([(f"p{i % 3}", f"f{i}", x.tolist()) for i, x in enumerate(values)], "problem string, file string, v array<double>")
    got = embed.pair_measures(v, block_rows=60)
    assert got.count() == n * (n - 1) // 2
    keys = {(f"p{i % 3}", f"f{i}"): x for i, x in enumerate(values)}
    some = {tuple(r)[:4]: r["unixcoder_l2"] for r in got.where("file_1 in ('f1', 'f2', 'f599') and file_2 in ('f1', 'f2', 'f599')").collect()}
    assert some == {(*x, *y): pytest.approx(float(np.linalg.norm(keys[x] - keys[y]))) for x, y in itertools.combinations(sorted(k for k in keys if k[1] in ("f1", "f2", "f599")), 2)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan
    assert embed.pair_measures(v.where("false")).count() == 0 and embed.pair_measures(v.limit(1)).count() == 0


def test_trigram_cosines_fetch_their_blocks(spark):
    """Bags are not copied for each square either, and the pairs with a key in common are all there."""
    rows = spark.createDataFrame([("p", f"f{i}", f"k{k}", 1.0 + i % 3) for i in range(40) for k in (i % 5, 5 + i % 2)], "problem string, file string, key string, w double")
    got = pairs.shared_cosine(rows, "s", 9)
    assert got.count() == sum(i % 5 == j % 5 or i % 2 == j % 2 for i in range(40) for j in range(i))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan


def test_dice_of_many_copies_is_exact():
    """Copies of a key are compared as a number and not one by one; sums beyond 2^24 are exact, few and many copies of keys add up."""
    import pyarrow as pa

    n = 2**24
    bags = [{1: n + 3, 2: 2, 3: 1}, {1: n + 1, 2: 9, 4: 7}, {}, {4: 5, 3: 4}]
    t = pa.table({"keys": [list(b) for b in bags], "ws": pa.array([[float(w) for w in b.values()] for b in bags], pa.list_(pa.float64()))})
    (got,) = pairs._dice(t, np.arange(4), np.arange(4))(slice(0, 4), slice(0, 4))
    for i, a in enumerate(bags):
        for j, b in enumerate(bags):
            both = sum(a.values()) + sum(b.values())
            assert got[i, j] == (2 * sum(min(w, b.get(k, 0)) for k, w in a.items()) / both if both else 0)


def test_equal_subtrees_of_a_file_are_hashed_once(monkeypatch):
    import hashlib

    import pyarrow as pa

    class Files:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            return run

    hashed, real = [], hashlib.md5
    monkeypatch.setattr(hashlib, "md5", lambda x: hashed.append(x) or real(x))
    batch = pa.RecordBatch.from_arrays([pa.array([x]) for x in ("p", "f", "f(a){b[1];}" * 400)], names=["problem", "file", "code"])
    (got,) = ast.tree_bags(Files())([batch])
    # unit, identifier, list, block, subscript, number, ;
    assert len(hashed) == got.num_rows == 7 and sum(got.column("w").to_pylist()) == 1 + 400 * 8
