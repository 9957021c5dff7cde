import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from textprofile.operators import explain as X
from textprofile.operators import models as M

D = 5


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(160, D))
    y = (x[:, 0] - 0.7 * x[:, 1] + x[:, 2] * x[:, 3] + 0.3 * rng.normal(size=160) > 0).astype(float)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(160)], "id long, x array<double>, label double")
    return df.select("id", array_to_vector("x").alias("features"), "label").cache()


def models(rows):
    yield "logistic", M.lr_l2(160).fit(rows)
    yield "network", M.mlp(D, (6,), max_iter=30, seed=1).fit(rows)
    yield "svm", M.rbf_svm(D, 0.2, n_components=64, seed=2, max_iter=30).fit(rows)
    yield "given", PipelineModel(stages=[M.LinearScorer([0.5, -1.0, 0.0, 2.0, 0.1], 0.3)])


def test_every_kind_of_model(spark, rows):
    """The scorer gives the model's own probability; attributions of a row sum to
    its score less the mean score of the backgrounds; errors cover the values of a
    long run."""
    head = rows.filter("id < 4")
    x = np.array([r.features.toArray() for r in rows.orderBy("id").collect()])
    for kind, model in models(rows):
        score = X.numpy_scorer(model)
        pred = model.transform(rows)
        own = dict(pred.select("id", M.positive_probability(pred).alias("p")).collect())
        assert np.allclose(score(x), [own[i] for i in range(160)], atol=1e-9), kind
        one = rows.filter("id = 9")  # a single background row: the sum is exact
        phi = X.sampled_attribution(model, head, one, "id", "features", D, samples=6, errors=True)
        total = {r.id: r.s for r in phi.groupBy("id").agg(F.sum("phi").alias("s")).collect()}
        assert all(total[i] == pytest.approx(score(x[i:i + 1])[0] - score(x[9:10])[0], abs=1e-9) for i in total) and len(total) == 4, kind
        phi = {(r.id, r.feature): r for r in X.sampled_attribution(model, head, rows, "id", "features", D, samples=40, errors=True).collect()}
        far = {(r.id, r.feature): r for r in X.sampled_attribution(model, head, rows, "id", "features", D, samples=240, seed=5, errors=True).collect()}
        off = [abs(phi[k].phi - far[k].phi) / np.hypot(phi[k].se, far[k].se) for k in phi if phi[k].se > 1e-12]
        assert np.mean(np.array(off) < 2.5) > 0.85, kind
        assert np.mean([far[k].se for k in far]) < np.mean([phi[k].se for k in phi])


def test_unknown_stages_are_named(rows):
    from pyspark.ml.feature import StandardScaler
    scaled = StandardScaler(inputCol="features", outputCol="s").fit(rows)
    with pytest.raises(ValueError, match="StandardScaler"):
        X.numpy_scorer(PipelineModel(stages=[scaled, M.LinearScorer([1.0] * D)]))
    with pytest.raises(ValueError, match="background"):
        X.sampled_attribution(M.LinearScorer([1.0] * D), rows, rows.limit(0), "id", "features", D)
