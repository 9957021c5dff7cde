from pyspark.sql import functions as F

from textprofile.operators import features as FE
from textprofile.operators import posts as P


def test_recent_posts_cases(spark):
    rows = [("a", f"p{i}", i) for i in range(5)] + [("b", "only", 7)] + \
           [("c", "x ||| y", 1), ("c", "tie1", 2), ("c", "tie2", 2)]
    df = spark.createDataFrame(rows, "author string, body string, created_utc long")
    df = df.withColumn("pid", F.monotonically_increasing_id())
    out = {r.author: (r.text, r.n_posts) for r in P.recent_posts(df, n=3, tiebreak="pid").collect()}
    assert out["a"] == ("p2 ||| p3 ||| p4", 3)
    assert out["b"] == ("only", 1)
    assert out["c"] == ("x ||| y ||| tie1 ||| tie2", 3)


def test_recent_posts_plan_limits_before_shuffle(spark):
    df = spark.range(1000).select(F.col("id").alias("created_utc"), (F.col("id") % 3).alias("author"),
                                  F.col("id").cast("string").alias("body"))
    plan = P.recent_posts(df, n=5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_recent_posts_cache(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1)], "author string, body string, created_utc long")
    path = str(tmp_path / "cache")
    first = P.recent_posts_cached(spark, df, path, n=2).collect()
    other = spark.createDataFrame([("z", "y", 1)], "author string, body string, created_utc long")
    assert P.recent_posts_cached(spark, other, path, n=2).collect() == first
    assert P.recent_posts_cached(spark, other, path, refresh=True, n=2).first().author == "z"


def test_zscore_constant_and_missing(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0, 1.0), (2, 2.0, 5.0, None), (3, 3.0, 5.0, 3.0)],
                               "k long, a double, c double, m double")
    out = {r.k: r for r in FE.zscore(df, ["a", "c", "m"], "k").collect()}
    assert abs(out[1].a + 1.224744871391589) < 1e-12 and out[3].c == 0.0 and out[2].m == 0.0
    assert abs(out[1].m + 1.0) < 1e-12
    compat = {r.k: r for r in FE.zscore(df, ["a", "m"], "k", compat=True).collect()}
    assert compat[1].m == 0.0 and compat[3].m == 0.0


def test_label_join_numeric_coercion(spark):
    feats = spark.createDataFrame([("12", 1.0), ("x", 2.0), ("7", None)], "author_id string, f double")
    labels = spark.createDataFrame([(12, 1), (7, 0)], "user long, t int")
    out = {r.author_id: (r.f, r.t) for r in FE.label_join(feats, labels, label_key="user", coerce_numeric=True).collect()}
    assert out == {12: (1.0, 1), 7: (0.0, 0)}


def test_feature_join_drops_missing_authors(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "author_id long, x double")
    b = spark.createDataFrame([(2, 3.0), (3, 4.0)], "author_id long, y double")
    assert [tuple(r) for r in FE.feature_join({"a": a, "b": b}).collect()] == [(2, 2.0, 3.0)]
    assert FE.feature_join({"a": a, "b": b}, ["a"]).count() == 2
