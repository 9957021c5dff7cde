import numpy as np
import pytest
from pyspark.sql import functions as F

from textprofile.operators import encoder as E
from textprofile.operators import features as FE
from textprofile.operators import lexicon as L
from textprofile.operators import moments as MO
from textprofile.sources import readers as RD
from textprofile.sources import writers as WR


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_groups_join_without_exchange(spark, tmp_path):
    root = str(tmp_path / "store")
    for g, m in (("one", 2), ("two", 3), ("three", 1)):
        df = spark.range(0, 300, m).select(F.col("id").alias("author_id"), (F.col("id") * m).alias(f"x.{g}"))
        WR.write_bucketed(df, root, g, buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for again in (False, True):
            if again:  # as another session would find them
                for g in ("one", "two", "three"):
                    spark.sql(f"DROP TABLE {WR.bucketed_name(root, g)}")
            joined = FE.feature_join(RD.open_bucketed(spark, root, ["one", "two", "three"]))
            plan = executed(joined)
            assert "SortMergeJoin" in plan and "Exchange" not in plan
            assert joined.count() == 50 and joined.filter("author_id = '6'").first()["x.two"] == 18.0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _scanned(df) -> int:
    """Rows that the scans gave out."""
    df.collect()
    todo, n = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        if p.nodeName().startswith("Scan parquet"):
            n += p.metrics().apply("numOutputRows").value()
        kids = [p.executedPlan()] if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else [p.children().apply(i) for i in range(p.children().size())]
        todo += kids
    return n


def test_row_groups_without_the_authors_are_skipped(spark, tmp_path):
    root = str(tmp_path / "emb")
    df = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("author_id"), F.lit(0).alias("chunk_no"),
                                    (F.col("id") % 2 + 1).cast("int").alias("layer"), F.array(*[F.rand(i) for i in range(8)]).alias("vec"))
    for c in WR.STORE_PARTITIONS:
        df = df.withColumn(c, F.lit("x"))
    WR.write_embedding_store(df, root, row_group_bytes=64 << 10)
    some = spark.createDataFrame(spark.range(3).select(F.md5(F.col("id").cast("string")).alias("author_id")).collect(), "author_id string")
    own = WR.read_embeddings(spark, root, "x", "x", "x", "x", authors=some)
    assert own.count() == some.join(df.select("author_id"), "author_id").count() > 0
    assert _scanned(own) < 10_000
    none = spark.createDataFrame([("5" + "0" * 31,), ("a" * 32,)], "author_id string")
    assert _scanned(WR.read_embeddings(spark, root, "x", "x", "x", "x", authors=none)) < 1_000  # inside the bounds, but not in the filters
    spark.conf.set("parquet.filter.bloom.enabled", "false")
    try:
        assert _scanned(WR.read_embeddings(spark, root, "x", "x", "x", "x", authors=none)) >= 1_000
    finally:
        spark.conf.unset("parquet.filter.bloom.enabled")
    joined = WR.of_authors(spark.read.parquet(root), some, max_named=1)
    assert joined.count() == own.count()


def test_large_lexicon_shuffles_its_own_words_only(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(4000)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, 60))) for i in range(50)] + [(50, ""), (51, None), (52, "none here")], "doc_id long, text string")
    lex = spark.createDataFrame([(f"w{i}", float(i), None if i % 5 else 1.0) for i in range(0, 4000, 10)] + [("w0", 7.0, 2.0)], "word string, a double, b double")
    small = L.lexicon_features(docs, lex, ["a", "b"])
    large = L.lexicon_features(docs, lex, ["a", "b"], max_broadcast=0)
    key = lambda r: r.doc_id
    for x, y in zip(sorted(small.collect(), key=key), sorted(large.collect(), key=key), strict=True):
        assert x.doc_id == y.doc_id and (x.a == pytest.approx(y.a) if x.a is not None else y.a is None) and x.b == y.b
    toks = docs.select("doc_id", F.split("text", " ").alias("_t"))
    kept = [r._k for r in L.lexicon_words(toks, lex.withColumnRenamed("word", "_k"), "doc_id").collect()]
    own = {r.word for r in lex.collect()}
    false = sum(k not in own for k in kept)
    assert false < 0.03 * 50 * 60 and len(kept) < 0.2 * 50 * 60


def test_moments_merge_and_score_unseen_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(1e6, 1e-2, 90), rng.normal(size=90), np.full(90, 3.0)])
    rows = [(i, *[None if (i % 7 == 0 and j == 1) else float(v) for j, v in enumerate(r)]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    path = str(tmp_path / "moments")
    for part, cond in (("p1", "id < 20"), ("p2", "id >= 20 and id < 60"), ("p2", "id >= 20 and id < 60")):
        MO.store_moments(df.filter(cond), ["a", "b", "c"], path, part)
    got = {r.feature: r for r in MO.stored_moments(spark, path).collect()}
    one = {r.feature: r for r in MO.column_moments(df.filter("id < 60"), ["a", "b", "c"]).collect()}
    for f in "abc":
        assert (got[f].n, got[f].missing) == (one[f].n, one[f].missing)
        assert got[f]["mean"] == pytest.approx(one[f]["mean"], rel=1e-12) and got[f].m2 == pytest.approx(one[f].m2, rel=1e-9)
    b = np.array([r[2] for r in rows[:60] if r[2] is not None])
    z = {r.id: r for r in MO.zscore_with(df.filter("id >= 60"), ["a", "b", "c"], "id", MO.stored_moments(spark, path)).collect()}
    assert all(r.c == 0.0 for r in z.values()) and z[63].b == 0.0 and z[61].b == pytest.approx((rows[61][2] - b.mean()) / b.std())
    compat = MO.zscore_with(df.filter("id >= 60"), ["b"], "id", MO.stored_moments(spark, path), compat=True)
    assert {r.b for r in compat.collect()} == {0.0}
    assert {r.a for r in MO.zscore_with(df, ["a"], "id", MO.column_moments(df.limit(0), ["a"])).collect()} == {0.0}


def test_batches_by_length_under_a_budget():
    rng = np.random.default_rng(3)
    lengths = np.append(rng.integers(0, 300, 500), [5000])
    batches = E.plan_batches(lengths, 4096)
    rows = np.concatenate(batches)
    assert sorted(rows) == list(np.flatnonzero(lengths)) and len(set(rows)) == len(rows)
    sizes = [len(b) * lengths[b].max() for b in batches]
    assert all(s <= 4096 or len(b) == 1 for s, b in zip(sizes, batches))
    assert 1 - lengths.sum() / sum(sizes) < 0.1  # padding
    in_order = [np.arange(i, min(i + 32, 500)) for i in range(0, 500, 32)]
    assert 1 - lengths[:500].sum() / sum(len(b) * lengths[b].max() for b in in_order) > 0.4
    assert E.plan_batches([]) == [] and E.plan_batches([0, 0]) == []


def test_id_encoder_restores_order_and_masks(spark):
    rows = [("b", [2, 5, 9, 3, 0, 0]), ("a", [2, 3]), ("c", None), ("d", []), ("e", [2] + [7] * 700 + [3]), ("a", [2, 3])]
    df = spark.createDataFrame(rows, "k string, ids array<bigint>").coalesce(1)
    got = E.embed_ids(df, "ids", "demo_ids", key="k", budget=64).collect()
    assert [(r.k, r.layer) for r in got] == [(k, j) for k, _ in rows for j in (1, 2)]
    for r, (_, ids) in zip(got[::2], rows):
        real = [i for i in ids or [] if i]
        assert r.vec is None if not real else r.vec == pytest.approx([np.mean([(i * 7 * d + 13) % 101 for i in real]) for d in range(1, 9)])
    first = E.embed_ids(df, "ids", "demo_ids", key="k", how="first").first()
    assert first.vec[0] == (2 * 7 + 13) % 101
    with pytest.raises(ValueError):
        E.embed_ids(df, "ids", "demo_ids", key="k", how="max")
