"""Lexical, hash and similarity functions against hand-computed values."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from simforge.functions import hashing, lexical, similarity
from simforge.operators import structure
from simforge.plans import detect

A = '#include <iostream>\nint main(){ // x\n  int n = 10; double s = 0.5;\n  for(int i=0;i<n;i++){ s += i; }\n  if (s > 3) cout << "hi"; return 0; }\n'
B = "int main(){ int k = 7; double t = 0.25; for(int j=0;j<k;j++){ t += j; } return 0; }"
OVERLAP = "for (int i=0;i<=n;++i){double d=foo(i); if(a&&b) printif(x); else do { y->z(); } while (q); return (1);}"


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("p", "a", A), ("p", "b", B)], "problem string, file string, code string")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    got = one(spark, lexical.tokens(F.lit(A)))
    assert " ".join(got) == "int main ( ) { int ID = ID ; double ID = ID . ID ; for ( int ID = ID ; ID < ID ; ID + + ) { ID + = ID ; } if ( ID > ID ) cout < < ID ; return ID ; }"
    assert len(one(spark, lexical.tokens(F.lit(B)))) == 43


def test_fingerprints(spark, files):
    fp = {r["file"]: r["fp"] for r in detect.token_fingerprints(files).collect()}
    assert (len(fp["a"]), len(fp["b"]), len(set(fp["a"]) & set(fp["b"]))) == (27, 19, 18)
    assert fp["a"][:3] == [45703963, 104549643, 276977727]
    assert detect.token_similarity(detect.token_fingerprints(files)).first()["S_token"] == pytest.approx(36 / 46)


@pytest.mark.parametrize("n", [0, 3, 4, 5, 6, 7])
def test_few_tokens(spark, n):
    h = hashing.kgram_hashes(F.array(*[F.lit(str(i)) for i in range(n)]).cast("array<string>"))
    assert len(one(spark, h)) == max(0, n - 3)
    assert len(one(spark, hashing.winnow(h))) <= max(0, n - 5) and (n < 6) == (one(spark, hashing.winnow(h)) == [])


def test_hashes(spark):
    assert one(spark, hashing.low32(F.lit("abc"))) == 685866866
    assert one(spark, hashing.bucket(F.lit("abc"))) == 8050
    leaf = one(spark, hashing.subtree_hash(F.lit("LEAF_identifier"), F.array().cast("array<string>")))
    assert leaf == "02c6d25e2cb13386a7f133b5a12fa81e"
    kids = [hashlib.md5((x + "_").encode()).hexdigest() for x in ("LEAF_identifier", "+", "LEAF_number_literal")]
    assert one(spark, hashing.subtree_hash(F.lit("binary_expression"), F.array(*map(F.lit, kids)))) == "c07d4b4eb40b56659828a4ac4266f2bd"
    assert one(spark, hashing.call_id(F.lit("x"))) == "call_" + hashlib.md5(b"x").hexdigest()[:8]


SEQ_A = "COMP COMP DECL CALL DECL COMP ASSIGN LOOP DECL COMP ASSIGN LOOP DECL COMP ASSIGN COMP ARITH ARITH ARITH COMP ASSIGN BRANCH CALL COMP COMP COMP RETURN"
SEQ_B = "DECL CALL DECL COMP ASSIGN LOOP DECL COMP ASSIGN LOOP DECL COMP ASSIGN COMP ARITH ARITH ARITH COMP ASSIGN RETURN"
SEQ_O = "LOOP CALL DECL COMP ASSIGN COMP ASSIGN ARITH ARITH LOOP DECL COMP ASSIGN CALL BRANCH LOGIC BRANCH LOOP ARITH COMP CALL LOOP CALL RETURN CALL"


@pytest.mark.parametrize("code, seq", [(A, SEQ_A), (B, SEQ_B), (OVERLAP, SEQ_O), ("", "")])
def test_structure_labels(spark, code, seq):
    assert " ".join(one(spark, lexical.structure_labels(F.lit(code)))) == seq
    assert " ".join(structure._labels(code)) == seq


def test_structure_features(spark, files):
    rows = {r["file"]: r for r in structure.features(files).collect()}
    assert rows["a"]["vec"] == pytest.approx([2, 1, 1, 2, 4, 0, 2, 2, 1.807509], abs=1e-6)
    assert rows["b"]["vec"] == pytest.approx([2, 0, 1, 1, 4, 0, 1, 2, 1.804741], abs=1e-6)
    a, b = ([structure._NUMBERS[x] for x in rows[f]["seq"]] for f in "ab")
    assert structure.lcs_matrix([np.array(a)], [np.array(b)], len(structure._NUMBERS)).tolist() == [[20]]
    got = structure.similarity(structure.features(files)).first()
    assert got["S_structure"] == 0.8177


def test_vector_similarity(spark):
    a, b = F.array(*[F.lit(float(x)) for x in (1, 0, 2)]), F.array(*[F.lit(float(x)) for x in (0, 0, 2)])
    assert one(spark, similarity.dot(a, b)) == 4
    assert one(spark, similarity.l2(a, b)) == 1
    assert one(spark, similarity.manhattan(a, b)) == 1
    assert one(spark, similarity.unit_l2_similarity(a, a)) == 1
    assert one(spark, similarity.set_dice(F.array().cast("array<int>"), F.array().cast("array<int>"))) == 0
    assert [one(spark, similarity.round4(F.lit(x))) for x in (2.67565, 0.00025, 0.03125)] == [2.6756, 0.0002, 0.0312]


def test_embedding_text(spark):
    code = '#include <x>\nusing namespace std;\n/* c\n */int  a = 1.5; // end\n\n\n\nchar c = \'x\';  \n  s = "t";\n'
    assert one(spark, lexical.embedding_text(F.lit(code))) == 'int a = NUM_LITERAL;\n\nchar c = CHAR_LITERAL;\n s = STRING_LITERAL;'


def test_types_and_names(spark):
    for name, kind in (("s10.cpp", 1), (" s29.cpp ", 2), ("s35", 3), ("s49.cpp", 4), ("s1.cpp", None), ("s50.cpp", None), ("x12.cpp", None)):
        assert one(spark, lexical.type_of_file(F.lit(name))) == kind
    assert one(spark, lexical.type_name(F.lit(3))) == "Type-3" and one(spark, lexical.type_name(F.lit(9))) is None
    text = one(spark, lexical.compilable(F.lit("int ()\n  = f(x);\n (a);\n")))
    assert text.endswith("int main()\n__anon_var__ = f(x);\n__anon_call__(a);\n")


def test_entity_free_depth(spark):
    assert one(spark, lexical.brace_depth(F.lit("}}{{{"))) == 1
    assert one(spark, lexical.brace_depth(F.lit('{"{{"}'))) == 1
    assert re.match("", "") is not None


def test_subsequences_match_dynamic_programming():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = np.random.default_rng(3)
    a, b = ([rng.integers(0, 4, n) for n in sizes] for sizes in ([0, 1, 5, 63, 64, 65, 130, 200], [0, 3, 64, 64, 128, 129, 7, 190]))
    assert structure.lcs_matrix(a, b, 4).tolist() == [[plain(x, y) for y in b] for x in a]


def test_long_subsequences_and_one_comparison_a_square(monkeypatch):
    """Sequences beyond the words' classes, and equal ones in several tiles of a square compared once."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 3, 2100), rng.integers(0, 3, 2500)
    row = np.zeros(len(y) + 1, np.int64)
    for label in x:
        row = np.maximum.accumulate(np.maximum(row, np.concatenate([[0], row[:-1] + (y == label)])))
    assert structure.lcs_matrix([x, x[:70]], [y], 3)[0, 0] == row[-1] == structure.lcs_matrix([y], [x], 3)[0, 0]
    asked = []
    plain = structure.lcs_matrix
    monkeypatch.setattr(structure, "lcs_matrix", lambda a, b, n: asked.append((len(a), len(b))) or plain(a, b, n))
    t = pa.table({"seq": [["LOOP", "CALL"]] * 3 + [["CALL"]] * 3, "vec": [[1.0] * 9] * 6})
    tile = structure._pair_scores(t, np.arange(6), np.arange(6))
    assert tile(slice(0, 3), slice(3, 6))[2].tolist() == [[0.5] * 3] * 3 and tile(slice(0, 3), slice(0, 3))[2].tolist() == [[1.0] * 3] * 3
    assert asked == [(2, 2)]


def test_equal_shapes_are_scored_once(monkeypatch):
    """In all tiles of a square: copies of a shape take no score of their own, a shape with another vector does."""
    import pyarrow as pa

    scored = []
    plain = structure._pair_scores

    def counting(t, left, right):
        tile = plain(t, left, right)
        return lambda x, y: scored.append((x.stop - x.start) * (y.stop - y.start)) or tile(x, y)

    monkeypatch.setattr(structure, "_pair_scores", counting)
    letter = lambda *x: "".join(chr(65 + structure._NUMBERS[i]) for i in x)
    rows = [(letter("LOOP", "CALL"), [1.0] * 9)] * 700 + [(letter("LOOP", "CALL"), [1.0] * 8 + [2.0])] * 2 + [("", [0.0] * 9)]
    t = pa.table({"code": [r[0] for r in rows], "vec": [r[1] for r in rows]})
    tile = structure._shape_scores(t, np.arange(703), np.arange(703))
    seqs = [["LOOP", "CALL"]] * 702 + [[]]
    whole = plain(pa.table({"seq": pa.array(seqs, pa.list_(pa.string())), "vec": [r[1] for r in rows]}), np.arange(703), np.arange(703))
    for x, y in itertools.product((slice(0, 512), slice(512, 703)), repeat=2):
        assert (tile(x, y)[0] == whole(x, y)[3]).all()
    assert sum(scored) == 9


def test_subsequences_by_blocks_and_one_by_one(monkeypatch):
    """A long sequence does not make a block of hundreds of short ones take its steps; both ways give the same lengths."""
    steps, plain = [], structure._lcs_words
    monkeypatch.setattr(structure, "_lcs_words", lambda a, b, *more: steps.append(max(map(len, b))) or plain(a, b, *more))
    rng = np.random.default_rng(5)
    a, b = ([rng.integers(0, 4, k) for k in rng.integers(50, 120, n)] + [rng.integers(0, 4, 1900)] for n in (150, 300))
    got = structure.lcs_matrix(a, b, 4)
    assert got.tolist() == [structure._lcs_long(x, b, 4) for x in a]
    assert steps and max(steps) < 120
