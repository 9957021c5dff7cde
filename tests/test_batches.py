"""Kernels over Arrow batches against their direct definitions."""

import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from textprofile.functions import batches as B
from textprofile.functions import text as T
from textprofile.functions import readability as RF
from textprofile.operators import lexicon as L
from textprofile.operators import readability as RO
from textprofile.operators import vectors as V

PIECES = ["RT", "FAV:", "12", "-3.5", "@bob:", "#x", ":)", "<3", "http://a.b/c", "www.x.y", "|||", "é", "I", "a", "b", "Hi,", "\U0001F600", "word"]
SPACES = [" ", " ", "  ", "\t", "\n", "　", "\x1c ", "  "]


def texts(n=300):
    rng = random.Random(5)
    return [None, "", " "] + ["".join(rng.choice(SPACES + [""]) + rng.choice(PIECES) for _ in range(rng.randrange(25))) + rng.choice(SPACES)
                              for _ in range(n)]


def by_expressions(social, rest):
    """The definition: one replacement after the other as column expressions."""
    def collapsed(c):
        return F.regexp_replace(c, T.WS + "+", " ")
    out = F.col("s")
    for name in T.SOCIAL_ORDER if social else ():
        for _ in range(2 if name in ("reserved", "numbers") else 1):
            out = F.regexp_replace(out, T.SOCIAL_PATTERNS[name], " ")
    return rest(F.trim(collapsed(out)) if social else out, collapsed)


def same(spark, fast, slow):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts())], "i long, s string").repartition(3)
    assert df.select(fast.alias("f"), slow.alias("s")).filter(~F.col("f").eqNullSafe(F.col("s"))).collect() == []
    plan = df.select(fast.alias("f"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_replace" not in plan


def test_clean_text_is_one_pass_over_batches(spark):
    def rest(c, collapsed):
        return F.regexp_replace(collapsed(F.regexp_replace(c, T.LINK, " ")), T.POST_SEPARATOR, " ")
    for social in (True, False):
        same(spark, T.clean_text("s", social=social), by_expressions(social, rest))


def test_clean_strict_is_one_pass_over_batches(spark):
    def rest(c, collapsed):
        c = F.regexp_replace(F.regexp_replace(c, T.LINK, " "), T.STRICT_KEEP, " ")
        return collapsed(F.regexp_replace(c, T.ISOLATED_LETTER, " "))
    for social in (True, False):
        same(spark, T.clean_strict("s", social=social), by_expressions(social, rest))


def test_hashing_over_batches_equals_array_expressions(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice(["a", "b", "é", "zz", None] + [f"w{j}" for j in range(40)]) for _ in range(n)])
            for i, n in enumerate([0, 1, 4, 5, 6, 8, 9, 50, 131, 0])] + [(98, None), (99, [None, None])]
    df = spark.createDataFrame(rows, "doc_id long, toks array<string>").repartition(2)
    for size, overlap, dim in ((None, 0, 64), (5, 2, 64), (8, 7, 16), (64, 16, 10)):
        fast = dict(V.hashing_window_mean(df, "doc_id", "toks", size, overlap, dim, batches=True).collect())
        slow = dict(V.hashing_window_mean(df, "doc_id", "toks", size, overlap, dim).collect())
        assert fast.keys() == slow.keys()
        for k, v in slow.items():
            assert fast[k] is None if v is None else fast[k] == pytest.approx(v, abs=1e-12), (k, size)


def test_row_slices_keep_to_the_budget():
    assert list(B.row_slices(np.array([3, 3, 9, 1, 0, 2]), 6)) == [(0, 2), (2, 3), (3, 6)]
    assert list(B.row_slices(np.array([], np.int64))) == []


def test_lexicon_words_are_counted_before_the_join(spark):
    docs = spark.createDataFrame([(1, "a a b c"), (2, "z z"), (3, ""), (4, None), (1, "a")], "doc_id long, text string")
    lex = spark.createDataFrame([("a", 2, None), ("b", 5, 1), ("a", 4, None)], "word string, s long, t long")
    rows = L.word_rows(docs.filter("doc_id <> 1 or text <> 'a'")).collect()
    assert sorted((r.doc_id, r["_k"], r["_n"]) for r in rows if r["_k"]) == [(1, "a", 2), (1, "b", 1), (1, "c", 1), (2, "z", 2)]
    assert sorted(r.doc_id for r in rows if r["_k"] is None) == [3, 4]
    got = {r.doc_id: (r.s, r.t) for r in L.lexicon_features(docs, lex, ["s", "t"]).collect()}
    # three a, each twice in the lexicon, and one b
    assert got == {1: (23 / 7, 1 / 7), 2: (None, None), 3: (None, None), 4: (None, None)}
    multi = L.lexicon_features_multi(docs, {"x": (lex.select("word", "s"), ["s"])}).collect()
    assert {r.doc_id: r.s for r in multi} == {k: v[0] for k, v in got.items()}


def test_vad_rows_are_counted_once(spark):
    from tests.conftest import SF_SMALL
    from textprofile.plans.q_model import _vad_folds
    df, _ = _vad_folds(spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" in plan and "Arrow" not in plan


def test_combined_rows_are_made_once_before_the_folds(spark, monkeypatch):
    from tests.conftest import SF_SMALL
    from textprofile.plans import q_model as Q
    plans = []
    folds = Q.FO.stratified_folds

    def seen(df, *args, **kw):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return folds(df, *args, **kw)
    monkeypatch.setattr(Q.FO, "stratified_folds", seen)
    monkeypatch.setattr(Q.M, "cross_validate", lambda df, *args, **kw: df)
    assert Q.q_cv_combined(spark, SF_SMALL).count() > 0
    assert len(plans) == 2 and all("Scan ExistingRDD" in p and "Scan parquet" not in p for p in plans)


def test_window_features_run_over_batches(spark):
    from textprofile.plans.q_model import window_features
    rows = [(i, s) for i, s in enumerate([None, "", " ".join(f"w{j % 37}" for j in range(200)), "Ab http://x.y a"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = window_features(df)
    assert "transform(" not in out._jdf.queryExecution().executedPlan().toString()
    toks = df.select("doc_id", T.tokenize(F.lower(T.clean_text("text"))).alias("toks"))
    want = dict(V.hashing_window_mean(toks, "doc_id", "toks", 64, 16).collect())
    for r in out.collect():
        assert r.features is None if want[r.doc_id] is None else r.features.toArray().tolist() == pytest.approx(want[r.doc_id])


def test_readability_counts_equal_column_expressions(spark):
    rng = random.Random(9)
    bits = ["The ", "table", "Beautiful", "a.b", "?!", " ", "\n", "\n \t\n", "é", "ÜBER ", "naïve", "12 ", "x_1 ", "--", "'s", "　", "idea ", "E ", "\x1c", ". "]
    rows = [(0, None), (1, ""), (2, " \n\n "), (3, "...")] + [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(60)))) for i in range(4, 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = df.select("doc_id", "text", RO.count_batches(F.col("text")).alias("c"))
    want = RF.counts(F.col("text"))
    wrong = got.select("text", *[F.col(f"c.{k}").alias(k) for k in want], *[v.alias(f"_{k}") for k, v in want.items()])
    wrong = wrong.filter(" or ".join(f"not ({k} <=> _{k})" for k in want))
    assert wrong.collect() == []
    lw = F.transform(RF.words("text"), RF.letters_lower)
    for r in got.select("c._words", lw.alias("lw")).collect():
        assert (r["_words"] is None) == (r.lw is None)
        assert r.lw is None or {w.word: w.n for w in r["_words"]} == Counter(r.lw)


def test_feature_join_counts_over_batches(spark):
    df = spark.createDataFrame([(1, "The cat sat. The end")], "doc_id long, text string")
    easy = spark.createDataFrame([("the",)], "word string")
    out = RO.readability(df, easy).select("doc_id", "words", "complex_words_dc")
    assert "transform(" not in out._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in out.collect()] == [(1, 5, 3)]
