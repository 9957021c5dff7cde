import numpy as np
import pytest

from textprofile.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, n string, x string, g string, component string"


def frame(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], v, "a", "b", "c", "d") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain(vectors, k=8):
    """Whitening by numpy's eigenvalues, vectors as integers of any size."""
    x = np.array([[int(np.floor(float(c) * 1024)) + 100000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    a = np.array([[float(v * n - t) / n for v, t in zip(row, s)] for row in x])
    e, v = np.linalg.eigh(a.T @ a / n)
    o = np.argsort(-e)
    dev = [sum(int(n * v - t) ** 2 for v, t in zip(row, s)) for row in x]
    return a @ v[:, o[:k]] / np.sqrt(e[o[:k]]), e[o] / e.sum(), dev


def run(spark, df, **kw):
    return whitening.whiten(whitening.fit(df), spark, **kw).collect()


@pytest.mark.parametrize("spread", [0, 6])
def test_equals_eigenvalues(spark, spread):
    """Also with columns whose scales differ by ``spread`` orders of magnitude."""
    rng = np.random.default_rng(3)
    a = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) * np.logspace(0, spread, 12)[::-1]
    vectors = a.astype(np.float32).tolist()
    want, share, dev = plain(vectors)
    rows = run(spark, frame(spark, vectors))
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == 300 * 8 == len(got)
    for c in range(8):
        mine = np.array([got[i, c + 1].whitened for i in range(300)])
        sign = np.sign(mine @ want[:, c])
        assert np.abs(mine * sign - want[:, c]).max() < (1e-9 if not spread else 1e-5)
        assert abs(got[0, c + 1].explained / share[c] - 1) < 1e-6
    assert [got[i, 1].deviation for i in range(300)] == [v if v < 1 << 63 else None for v in dev]
    assert all(r.n == 300 and r.identity_error < 1e-9 for r in rows)


def test_passes_orthogonalise_and_solve():
    rng = np.random.default_rng(1)
    r = np.triu(rng.normal(size=(6, 6))) + 3 * np.eye(6)
    a = rng.normal(size=(20, 6))
    assert np.allclose(whitening.solve_rows(a, r) @ r, a)


def test_more_than_one_pass(spark):
    rng = np.random.default_rng(2)
    m = whitening.fit(frame(spark, (rng.normal(size=(100, 5)) * [1e3, 1, 1, 1, 1e-1]).tolist()))
    assert m.passes >= 2


def test_awkward_rows(spark):
    good = [[1.0, 2.0, 0.5], [2.0, 1.0, 0.25], [0.5, 0.5, 4.0], [0.5, 0.5, 4.0], [1.5, 3.0, 1.0]]
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [1.0, float("inf"), 1.0], [1.0, 2.0], [1e30, 1.0, 1.0]]
    ids = [1, 2, None, 4, 4, *range(10, 17)]
    rows = run(spark, frame(spark, good + bad, ids))
    want, _, dev = plain(good, 3)
    assert sorted(str(r.vec_id) for r in rows if r.component == 1) == sorted(map(str, [1, 2, None, 4, 4]))
    assert sorted({r.component for r in rows}) == [1, 2, 3] and all(r.n == 5 for r in rows)
    assert sorted(r.deviation for r in rows if r.component == 2) == sorted(dev)
    for c in range(3):
        mine = sorted(abs(r.whitened) for r in rows if r.component == c + 1)
        assert np.allclose(mine, sorted(np.abs(want[:, c])), atol=1e-9)


def test_without_variance(spark):
    assert run(spark, frame(spark, [])) == []
    assert run(spark, frame(spark, [None, []])) == []
    assert run(spark, frame(spark, [[1.0, 2.0]])) == []
    assert run(spark, frame(spark, [[1.0, 2.0]] * 5)) == []
    rows = run(spark, frame(spark, [[1.0, 7.0, 0.5], [2.0, 7.0, 1.0], [4.0, 7.0, 2.0]]))  # rank 1
    assert {r.component for r in rows} == {1} and len(rows) == 3
    assert abs(rows[0].explained - 1) < 1e-9 and rows[0].identity_error < 1e-9


def test_deviation_beyond_64_bits():
    x = np.array([[1 << 40, 0], [0, 0]], dtype=np.int64)
    assert whitening.deviations(x, [1 << 40, 0], 2) == [None, None]
    assert whitening.deviations(np.array([[3, 1]]), [4, 4], 2) == [2 * 2 + 2 * 2]
