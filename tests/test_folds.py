import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textprofile.operators import folds as FO
from textprofile.operators.rank import global_position, prefix_sum


def stratified_reference(y, k):
    """Restatement of the published unshuffled stratified k-fold algorithm."""
    y = np.asarray(y)
    _, idx, inv = np.unique(y, return_index=True, return_inverse=True)
    _, perm = np.unique(idx, return_inverse=True)
    enc = perm[inv]
    n_cls = len(idx)
    order = np.sort(enc)
    alloc = np.asarray([np.bincount(order[i::k], minlength=n_cls) for i in range(k)])
    folds = np.empty(len(y), dtype=int)
    for c in range(n_cls):
        folds[enc == c] = np.arange(k).repeat(alloc[:, c])
    return folds


@settings(max_examples=15, deadline=None)
@given(labels=st.lists(st.integers(0, 2), min_size=30, max_size=150))
def test_stratified_equals_reference(spark, labels):
    df = spark.createDataFrame([(i * 3 + 1, y) for i, y in enumerate(labels)], "id long, y long")
    got = {r.id: r.fold for r in FO.stratified_folds(df, "y", "id", k=10).collect()}
    ref = stratified_reference(labels, 10)
    assert [got[i * 3 + 1] for i in range(len(labels))] == list(ref)


def test_stratified_properties(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 257)
    df = spark.createDataFrame([(int(i), int(v)) for i, v in enumerate(y)], "id long, y long")
    out = FO.stratified_folds(df, "y", "id", k=10).toPandas()
    assert len(out) == 257 and out.id.is_unique
    per = out.groupby(["y", "fold"]).size().unstack(fill_value=0)
    assert (per.max(axis=1) - per.min(axis=1)).max() <= 1


def test_kfold_sizes_and_disjoint(spark):
    df = spark.range(103).withColumnRenamed("id", "doc_id")
    out = FO.kfold_shuffled(df, "doc_id", k=10, seed=0).toPandas()
    sizes = out.groupby("fold").size().tolist()
    assert sizes == [11, 11, 11] + [10] * 7
    for f in range(10):
        tr, te = FO.train_test(FO.kfold_shuffled(df, "doc_id", 10, 0), f)
        assert tr.join(te, "doc_id").count() == 0


def test_holdout(spark):
    df = spark.range(100).withColumnRenamed("id", "doc_id")
    c = {r.split: r["count"] for r in FO.holdout_split(df, "doc_id").groupBy("split").count().collect()}
    assert c == {"train": 72, "val": 8, "test": 20}


def test_global_position_matches_row_number(spark):
    rng = np.random.default_rng(1)
    vals = rng.integers(0, 50, 1000)
    df = spark.createDataFrame([(int(i), int(v)) for i, v in enumerate(vals)], "id long, v long")
    got = global_position(df, ["v", "id"], name="p", num_partitions=7).toPandas().sort_values("p")
    exp = sorted(range(1000), key=lambda i: (vals[i], i))
    assert got.id.tolist() == exp and got.p.tolist() == list(range(1000))


def test_prefix_sum(spark):
    df = spark.createDataFrame([(i, (i % 4) + 1) for i in range(50)], "k long, n long")
    got = {r.k: r.start for r in prefix_sum(df, ["k"], "n", name="start", num_partitions=5).collect()}
    acc = 0
    for i in range(50):
        assert got[i] == acc
        acc += (i % 4) + 1


def test_fold_counts(spark):
    df = spark.createDataFrame([(i, i % 2, i % 5) for i in range(20)], "id long, y long, fold long")
    rows = {r.fold: (r.n_train, r.n_test) for r in FO.fold_counts(df, "y", 5).collect()}
    assert rows == {f: (16, 4) for f in range(5)}
