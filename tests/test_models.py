import math

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from textprofile.functions.numeric import round_to, softmax
from textprofile.operators import explain as X
from textprofile.operators import models as M
from textprofile.plans.tables import load
from tests.conftest import SF_MID, SF_SMALL


def _separable(spark):
    emb = load(spark, SF_MID, "embeddings")
    return emb.select("vec_id", array_to_vector("embedding").alias("features"),
                      (F.col("embedding")[0] > 0).cast("double").alias("label"))


def test_lr_beats_majority_and_roundtrips(spark, tmp_path):
    df = _separable(spark)
    model = M.lr_l2(df.count()).fit(df)
    acc = M.accuracy(model.transform(df)).first().acc
    majority = max(df.filter("label = 1").count(), df.filter("label = 0").count()) / df.count()
    assert acc > majority
    path = M.save_model(model, str(tmp_path), "lr", "t")
    back = M.load_models(str(tmp_path), "lr", ["t"])["t"]
    a = [r.prediction for r in model.transform(df).orderBy("vec_id").collect()]
    b = [r.prediction for r in back.transform(df).orderBy("vec_id").collect()]
    assert a == b and path.endswith("lr/t")


def test_missing_model_message(spark, tmp_path):
    import pytest
    with pytest.raises(FileNotFoundError, match="trait 'x'"):
        M.load_models(str(tmp_path), "lr", ["x"])


def test_rbf_svm_and_mlp_learn(spark):
    df = _separable(spark)
    g = M.gamma_scale(load(spark, SF_MID, "embeddings"), "embedding").first().gamma
    svm = M.rbf_svm(64, g, n_components=128, seed=1, max_iter=50).fit(df)
    assert M.accuracy(svm.transform(df)).first().acc > 0.7
    mlp = M.mlp(64, (16,), max_iter=60, seed=0).fit(df)
    assert M.accuracy(mlp.transform(df)).first().acc > 0.7


def test_rff_approximates_kernel(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 6)) * 0.5
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(40)], "id long, v array<double>") \
        .withColumn("features", array_to_vector("v"))
    rff = M.RandomFourierFeatures("features", "z", gamma=0.5, n_components=2000, n_features=6, seed=0)
    z = np.array([r.z for r in rff.transform(df).select("id", vector_to_array("z").alias("z")).orderBy("id").collect()])
    approx = z @ z.T
    exact = np.exp(-0.5 * ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    assert np.abs(approx - exact).mean() < 0.05


def test_cross_validation_no_leak_and_rows(spark):
    from textprofile.plans.q_model import _emb_folds
    df = _emb_folds(spark, SF_SMALL)
    res = M.cross_validate(df, ["odd"], lambda n, t: M.lr_l2(n), k=10)
    rows = res.collect()
    assert sorted(r.fold for r in rows) == list(range(1, 11))
    assert all(0.0 <= r.acc <= 1.0 for r in rows)


def test_best_per_group_tie_earliest(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.7), ("a", 3, 0.7), ("b", 1, 0.1)], "trait string, fold int, acc double")
    got = {r.trait: r.fold for r in M.best_per_group(df).collect()}
    assert got == {"a": 2, "b": 1}


def test_softmax_and_threshold(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([1.0, 3.0],)], "a array<double>")
    rows = df.select(softmax("a").alias("p")).collect()
    assert rows[0].p == [0.5, 0.5]
    assert abs(sum(rows[1].p) - 1.0) < 1e-12
    assert abs(rows[1].p[1] - math.exp(3) / (math.exp(1) + math.exp(3))) < 1e-12


def test_score_decision_strict(spark):
    df = _separable(spark)
    model = M.PipelineModel(stages=[M.lr_l2(df.count()).fit(df)])
    sc = M.score(df.select(F.col("vec_id").alias("doc_id"), "features"), {"t": model, "u": model})
    assert sc.count() == 2 * df.count()
    bad = sc.filter(((F.col("probability") > 0.5) & (F.col("decision") != "Yes")) |
                    ((F.col("probability") <= 0.5) & (F.col("decision") != "No"))).count()
    assert bad == 0


def test_linear_attributions_sum_to_score_gap(spark):
    w = [0.5, -1.0, 2.0]
    df = spark.createDataFrame([(i, float(i), float(i * i % 7), float(3 - i)) for i in range(10)], "k long, a double, b double, c double")
    phi = X.linear_attribution(df, "k", ["a", "b", "c"], w).groupBy("k").agg(F.sum("phi").alias("s"))
    pdf = df.toPandas()
    scores = pdf.a * w[0] + pdf.b * w[1] + pdf.c * w[2]
    gap = dict(zip(pdf.k, scores - scores.mean()))
    for r in phi.collect():
        assert abs(r.s - gap[r.k]) < 1e-9


def test_sampled_attribution_rows(spark):
    from textprofile.plans.q_model import q_sampled_attribution
    out = q_sampled_attribution(spark, SF_SMALL)
    assert out.count() == 100 * 64  # the whole 20 % test split, all dimensions
    assert out.filter(F.col("phi").isNull()).count() == 0


def test_sampled_attribution_tracks_linear_truth(spark):
    """For a logistic model the sampled attributions of the probability keep
    the sign of the exact logit attributions for clearly non-zero ones."""
    df = _separable(spark).limit(200)
    model = M.lr_l2(200).fit(df)
    w = model.coefficients.toArray()
    rows = df.orderBy("vec_id").limit(10)
    phi = X.sampled_attribution(model, rows, df, "vec_id", "features", 64, samples=64, seed=3).toPandas()
    bg_mean = np.array(df.select(vector_to_array("features").alias("a")).toPandas().a.tolist()).mean(0)
    x = {r.vec_id: np.array(r.a) for r in rows.select("vec_id", vector_to_array("features").alias("a")).collect()}
    agree = total = 0
    for r in phi.itertuples():
        exact = w[r.feature] * (x[r.vec_id][r.feature] - bg_mean[r.feature])
        if abs(exact) > 0.5:
            total += 1
            agree += np.sign(exact) == np.sign(r.phi)
    assert total > 0 and agree / total > 0.9


def test_round_to_matches_scaled_rounding(spark):
    df = spark.createDataFrame([(11.471643499999999,), (0.1234565,), (-2.5e-7,)], "x double")
    got = [r.r for r in df.select(round_to("x", 6).alias("r")).collect()]
    assert got == [round(11.471643499999999 * 1e6) / 1e6, 0.123457, -0.0] or got[0] == 11.471643
