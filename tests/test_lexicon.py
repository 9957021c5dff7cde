from pyspark.sql import functions as F

from textprofile.operators import lexicon as L


def test_weighted_mean_hand_computed(spark):
    docs = spark.createDataFrame([(1, "good good bad other"), (2, "other"), (3, "Good"), (4, "")],
                                 "doc_id long, text string")
    lex = spark.createDataFrame([("good", 1.0), ("bad", -1.0)], "word string, s double")
    out = {r.doc_id: r.s for r in L.lexicon_features(docs, lex, ["s"]).collect()}
    assert round(out[1], 6) == 0.333333
    assert out[2] is None and out[3] is None and out[4] is None


def test_duplicate_lexicon_keys_multiply(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    lex = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 0.0)], "word string, s double")
    out = L.lexicon_features(docs, lex, ["s"]).first()
    assert out.s == (1.0 + 3.0 + 0.0) / 3


def test_null_cell_counts_token(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    lex = spark.createDataFrame([("a", 2.0), ("b", None)], "word string, s double")
    assert L.lexicon_features(docs, lex, ["s"]).first().s == 1.0


def test_concept_features_and_bag(spark):
    docs = spark.createDataFrame([(1, "x x y z"), (2, "q")], "doc_id long, text string")
    bags = L.concept_bag(docs)
    exploded = {(r.doc_id, r.concept): r["count"] for r in L.explode_concepts(bags).collect()}
    assert exploded == {(1, "x"): 2, (1, "y"): 1, (1, "z"): 1, (2, "q"): 1}
    lex = spark.createDataFrame([("x", 1.0), ("y", 4.0)], "concept string, p double")
    out = {r.doc_id: r.p for r in L.concept_features(bags, lex, ["p"]).collect()}
    assert out[1] == (2 * 1.0 + 4.0) / 3 and out[2] is None
    vecs = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [4.0, 3.0])], "concept string, vec array<double>")
    got = {(r.doc_id, r.dim): r.value for r in L.concept_vector_features(bags, vecs).collect()}
    assert got[(1, 0)] == 2.0 and got[(1, 1)] == 1.0 and got[(2, None)] is None


def test_coverage(spark):
    docs = spark.createDataFrame([(1, "a a b c")], "doc_id long, text string")
    lex = spark.createDataFrame([("a",), ("c",)], "word string")
    r = L.lexicon_coverage(docs, lex).first()
    assert (r.n_words, r.n_hits) == (3, 2)
    assert abs(r.coverage - 2 / 3) < 1e-12


def test_lexicon_plan_is_broadcast_and_pruned(spark):
    from tests.conftest import SF_SMALL
    from textprofile.plans import derived as D
    from textprofile.plans.tables import load
    df = L.lexicon_features(load(spark, SF_SMALL, "documents"), D.emotion_lexicon(spark, SF_SMALL), D.EMOTIONS)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
