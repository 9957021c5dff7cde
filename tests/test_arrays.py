from collections import Counter

import pytest
from pyspark.sql import functions as F

from textprofile.functions import arrays as A
from textprofile.operators import lexicon as L
from textprofile.operators import vectors as V


def test_run_lengths(spark):
    rows = [("a b a c a b",), ("",), (None,), ("x",), (" ".join("ab" * 40),), ("é e É é",)]
    df = spark.createDataFrame(rows, "t string")
    words = F.split("t", " ")
    got = df.select("t", A.run_lengths(words).alias("r")).collect()
    for r in got:
        assert r.r is None if r.t is None else [(x.value, x["count"]) for x in r.r] == sorted(Counter(r.t.split(" ")).items())
    empty = spark.createDataFrame([([],), ([None],), ([3, None, 3],)], "a array<int>").select(A.run_lengths(F.col("a")).alias("r")).collect()
    assert [[tuple(x) for x in r.r] for r in empty] == [[], [], [(3, 2)]]


def test_counts_by_code_and_unit(spark):
    df = spark.createDataFrame([([0, 0, 1, 4, 5, 5, 7],), ([],)], "c array<int>")
    got = [r.v for r in df.select(A.counts_by_code(F.col("c"), 4).alias("v")).collect()]
    assert got == [[1.0, 0.0, -1.0, -1.0], [0.0] * 4]
    got = df.select(A.unit(A.counts_by_code(F.col("c"), 4)).alias("v")).first().v
    assert got == pytest.approx([3 ** -0.5, 0, -3 ** -0.5, -3 ** -0.5])


def test_no_python_in_bags_and_hashing(spark):
    df = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None)], "doc_id long, text string")
    bags = L.concept_bag(df)
    toks = df.select("doc_id", F.split("text", " ").alias("toks"))
    for out in (bags, V.hashing_embed_docs(toks, "doc_id", "toks"), V.hashing_window_mean(toks, "doc_id", "toks", 4, 1)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert {r.doc_id: [tuple(x) for x in r.concept_count] for r in bags.collect()} == {1: [("a", 1), ("b", 2)], 2: [], 3: []}


def test_window_mean_equals_numpy(spark):
    """Windows of hashed codes in array expressions and in numpy."""
    import numpy as np
    docs = [(i, [f"w{(i * j) % 11}" for j in range(n)]) for i, n in enumerate([0, 1, 4, 5, 9, 30])]
    df = spark.createDataFrame(docs, "doc_id long, toks array<string>")
    codes = dict(df.select("doc_id", V._token_codes("toks", 8)).collect())
    got = dict(V.hashing_window_mean(df, "doc_id", "toks", 5, 2, dim=8).collect())
    for i, toks in docs:
        want = V._hash_vectors(np.array(codes[i]), 5, 3, 8) if toks else None
        assert got[i] is None if want is None else got[i] == pytest.approx(want.tolist())


def test_concept_vectors_with_missing_cells(spark):
    bags = L.concept_bag(spark.createDataFrame([(1, "a a b"), (2, "z"), (3, "c")], "doc_id long, text string"))
    lex = spark.createDataFrame([("a", [1.0, None, None]), ("b", [4.0, 2.0, None]), ("c", [None, None, 5.0])], "concept string, vec array<double>")
    got = sorted((r.doc_id, r.dim, r.value) for r in L.concept_vector_features(bags, lex).collect() if r.doc_id != 2)
    assert got == [(1, 0, 2.0), (1, 1, pytest.approx(2 / 3)), (1, 2, None), (3, 0, None), (3, 1, None), (3, 2, 5.0)]
    assert [(r.dim, r.value) for r in L.concept_vector_features(bags, lex).collect() if r.doc_id == 2] == [(None, None)]
