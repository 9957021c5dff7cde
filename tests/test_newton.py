import numpy as np
import pytest

from textprofile.operators import newton as N


def solve(x, y, c=1.0):
    """Newton's method in numpy on the given rows."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.append(np.ones(x.shape[1] - 1), 0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        g, h = c * x.T @ (p - y) + ridge * w, c * (x.T * (p * (1 - p))) @ x + np.diag(ridge)
        w = w - np.linalg.solve(h, g)
    return w


def data(spark, n=240, d=4, k=5, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    a = (x[:, 0] + rng.normal(size=n) > 0).astype(int)
    b = (x[:, 1] - x[:, 2] + rng.normal(size=n) > 0.5).astype(int)
    fa, fb = rng.integers(0, k, n), rng.integers(0, k, n)
    rows = [(x[i].tolist(), int(a[i]), int(b[i]), int(fa[i]), int(fb[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "features array<double>, a int, b int, fold_a int, fold_b int").repartition(3)
    return df, x, {"a": (a, fa), "b": (b, fb)}


@pytest.mark.parametrize("c", [1.0, 0.05])
def test_equals_newton_in_numpy(spark, c):
    df, x, labels = data(spark)
    m = N.fit_folds(df, ["a", "b"], k=5, c=c)
    acc = {(r.trait, r.fold): r.acc for r in m.accuracies().collect()}
    for t, (y, fold) in labels.items():
        for f in range(5):
            want = solve(x[fold != f], y[fold != f], c)
            assert np.abs(m.weights[["a", "b"].index(t), f] - want).max() < 1e-6
            yes = np.column_stack([x, np.ones(len(x))])[fold == f] @ want > 0
            assert acc[t, f + 1] == pytest.approx((yes == y[fold == f]).mean())


def test_scans_do_not_grow_with_folds(spark):
    scans = [N.fit_folds(data(spark, k=k)[0], ["a", "b"], k=k).scans for k in (2, 10)]
    assert max(scans) <= 12 and abs(scans[0] - scans[1]) <= 1


def test_missing_values_and_empty_folds(spark):
    df = spark.createDataFrame([([1.0], 1, 0), ([2.0], 0, 1), ([0.5], 1, 1), (None, 1, 0), ([1.0], None, 0), ([3.0], 0, None)],
                               "features array<double>, a int, fold int")
    m = N.fit_folds(df, ["a"], k=3)
    assert {r.fold for r in m.accuracies().collect()} == {1, 2} and m.weights.shape == (1, 3, 2)
    with pytest.raises(ValueError):
        N.fit_folds(df.limit(0), ["a"], k=2)


def test_steep_start_is_halved(spark):
    """Values so large that a full step overshoots."""
    rng = np.random.default_rng(5)
    x = rng.standard_cauchy(size=(120, 2)) * 30
    y = (x[:, 0] + rng.normal(size=120) * 20 > 0).astype(int)
    fold = np.arange(120) % 2
    df = spark.createDataFrame([(x[i].tolist(), int(y[i]), int(fold[i])) for i in range(120)], "features array<double>, a int, fold int")
    m = N.fit_folds(df, ["a"], k=2)
    xs = np.column_stack([x, np.ones(120)])
    for f in range(2):
        tr = fold != f
        w = m.weights[0, f]
        p = 1 / (1 + np.exp(-xs[tr] @ w))
        assert np.abs(xs[tr].T @ (p - y[tr]) + np.append(w[:-1], 0)).max() < 1e-5
