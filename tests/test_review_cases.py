"""Inputs of the kinds that plain round trips don't hold."""

from decimal import Decimal

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from textprofile.operators import explain as X
from textprofile.operators import folds as FO
from textprofile.operators import lexicon as LX
from textprofile.operators import models as M
from textprofile.operators import posts as PO
from textprofile.operators import vectors as V
from textprofile.operators.joins import sized_lookup
from textprofile.sources import readers as RD
from textprofile.sources import writers as WR


def test_quotes_survive_every_csv_reader(spark, tmp_path):
    words = ['he said "x"', 'he"llo', " spaced ", "two\nlines", "plain"]
    lex = spark.createDataFrame([(w, i, -i) for i, w in enumerate(words)], "word string, a int, b int")
    WR.write_csv(lex, str(tmp_path / "csv"))
    assert {r["word"]: r["a"] for r in RD.read_lexicon(spark, str(tmp_path / "csv")).collect()} == {w: float(i) for i, w in enumerate(words)}
    WR.write_csv(lex, str(tmp_path / "vec"), header=False)
    got = RD.read_concept_vectors(spark, str(tmp_path / "vec")).collect()
    assert {r["concept"]: r["vec"] for r in got} == {w: [float(i), -float(i)] for i, w in enumerate(words)}
    WR.write_features(lex.withColumnRenamed("word", "author_id"), str(tmp_path / "f"), "g")
    assert {r["author_id"] for r in RD.read_feature_group(spark, str(tmp_path / "f"), "g").collect()} == set(words)
    affect = lex.select(F.col("word").alias("key"), F.col("a").alias("polarity_value"), F.lit("x").alias("semantics1"))
    WR.write_csv(affect, str(tmp_path / "aff"))
    back = RD.read_concept_affect(spark, str(tmp_path / "aff"))
    assert back.columns == ["concept", "polarity_value"] and {r["concept"] for r in back.collect()} == set(words)


def test_fractional_times(spark, tmp_path):
    df = spark.createDataFrame([("a", "one", "1500000000.0"), ("a", "two", "1500000000.5"), ("a", "three", "1499999999")],
                               "author string, body string, created_utc string")
    WR.write_csv(df, str(tmp_path / "p"))
    posts = RD.read_posts(spark, str(tmp_path / "p"))
    assert {r["created_utc"] for r in posts.collect()} == {Decimal("1500000000"), Decimal("1500000000.5"), Decimal("1499999999")}
    assert PO.recent_posts(posts, n=2).first()["text"] == "one ||| two"


def test_arff_names_and_several_relations(spark, tmp_path):
    attrs = [("filename", "string"), ("'Emotional stability'", "numeric"), *[(f"a{i}", "numeric") for i in range(9)]]
    for k in (1, 2):
        rows = spark.createDataFrame([(f"'d\\\\id_{k}{i}'," + ",".join(str(k * j) for j in range(10)),) for i in range(3)], "value string")
        WR.write_arff(spark, rows, str(tmp_path / f"r/{k}"), "x", attrs)
    out = RD.read_arff(spark, str(tmp_path / "r"))
    assert out.columns == ["idx", "Emotional stability", *[f"a{i}" for i in range(9)]]
    assert sorted(r["idx"] for r in out.collect()) == [10, 11, 12, 20, 21, 22]
    assert {(r["idx"] // 10, r["a8"]) for r in out.collect()} == {(1, 9.0), (2, 18.0)}
    WR.write_arff(spark, rows, str(tmp_path / "r/3"), "x", attrs[:-1])
    with pytest.raises(ValueError, match="different attributes"):
        RD.read_arff(spark, str(tmp_path / "r"))


def test_null_cells_count_in_both_lexicon_forms(spark):
    docs = spark.createDataFrame([(1, "x y y")], "doc_id bigint, text string")
    cells = [("x", 1.0), ("y", None)]
    flat = LX.lexicon_features(docs, spark.createDataFrame(cells, "word string, s double"), ["s"]).first()["s"]
    vec = spark.createDataFrame([(w, [c]) for w, c in cells], "concept string, vec array<double>")
    got = LX.concept_vector_features(LX.concept_bag(docs), vec).first()["value"]
    assert flat == got == pytest.approx(1 / 3)


def test_documents_without_tokens_stay(spark):
    docs = spark.createDataFrame([("a", ["x"]), ("b", []), ("c", None)], "author string, toks array<string>")
    got = {r["author"]: r["vec"] for r in V.hashing_embed_docs(docs, "author", "toks").collect()}
    assert got["b"] is None and got["c"] is None and sum(x * x for x in got["a"]) == pytest.approx(1)
    assert {r["author"]: r["vec"] for r in V.embed(docs, "toks", "hashing64_numpy", key="author").collect()} == got
    texts = docs.select("author", F.array_join("toks", " ").alias("text"))
    cov = LX.lexicon_coverage(texts, spark.createDataFrame([("x",)], "word string"), doc_key="author").collect()
    assert {r["author"]: (r["n_words"], r["coverage"]) for r in cov} == {"a": (1, 1.0), "b": (0, None), "c": (0, None)}


def test_layered_encoder(spark):
    V.register_encoder("two_layers", lambda: lambda batch: np.array([[[len(t)] * 3, [-len(t)] * 3] for t in batch]), 3, layers=2)
    docs = spark.createDataFrame([("a", ["x", "y"]), ("b", [])], "author string, toks array<string>")
    rows = {(r["author"], r["layer"]): r["vec"] for r in V.embed_layers(docs, "toks", "two_layers", key="author").collect()}
    assert rows == {("a", 1): [2.0] * 3, ("a", 2): [-2.0] * 3, ("b", 1): None, ("b", 2): None}
    assert V.embed(docs, "toks", "two_layers", key="author", layer=1).filter("vec is not null").first()["vec"] == [2.0] * 3


def test_strata_with_nulls_and_many_groups(spark):
    rows = [(i, f"g{i % 150}" if i % 7 else None, i % 2 if i % 11 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, g string, y int")
    out = FO.stratified_folds(df, "y", "id", k=5, by=["g"]).collect()
    assert len(out) == 3000 and {r["fold"] for r in out} == set(range(5))
    by = {}
    for r in sorted(out, key=lambda r: r["id"]):
        by.setdefault((r["g"], r["y"]), []).append(r["fold"])
    for folds in by.values():  # contiguous runs, even sizes
        assert folds == sorted(folds)
        sizes = [folds.count(f) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_store_partition_is_written_by_several_tasks(spark, tmp_path):
    df = spark.range(4000).selectExpr("id as author_id", "0 as chunk_no", "cast(id % 4 as int) as layer", "array(1.0D) as vec",
                                      "'d' as dataset", "'e' as encoder", "'p' as pool", "'m' as mode")
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(conf)
    spark.conf.set(conf, "false")  # so small a table would be put together again
    try:
        WR.write_embedding_store(df, str(tmp_path / "s"))
    finally:
        spark.conf.set(conf, old)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.select(F.input_file_name()).distinct().count() > 1 and back.count() == 4000


def test_svm_probability_is_logistic_of_the_margin(spark):
    df = spark.createDataFrame([([-1.5, 1.5],)], "r array<double>").select(array_to_vector("r").alias("rawPrediction"))
    assert df.select(M.positive_probability(df).alias("p")).first()["p"] == pytest.approx(1 / (1 + np.exp(-1.5)))


def test_attribution_walks(spark):
    """Contributions add up to the score less the backgrounds' score, for a
    logistic model and for a network."""
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(60)]
    df = spark.createDataFrame([(i, x, float(x[0] + x[1] > 0)) for i, x in rows], "id bigint, x array<double>, label double")
    df = df.select("id", "label", array_to_vector("x").alias("features")).checkpoint()
    for est in (M.lr_l2(60), M.mlp(5, (4,), max_iter=30)):
        model = est.fit(df)
        score = X.numpy_scorer(model)
        want = {r["id"]: r["probability"][1] for r in model.transform(df).collect()}
        got = score(np.array([x for _, x in rows]))
        assert np.allclose(got, [want[i] for i, _ in rows], atol=1e-9)
        one = df.filter("id = 3")
        phi = X.sampled_attribution(model, df.limit(8), one, "id", "features", 5, samples=4).groupBy("id").agg(F.sum("phi").alias("s"))
        for r in phi.collect():
            assert r["s"] == pytest.approx(want[r["id"]] - want[3], abs=1e-9)


def test_cache_hides_no_other_error(spark, tmp_path):
    bad = tmp_path / "bad.parquet"
    bad.write_text("not parquet")
    posts = spark.createDataFrame([("a", 1, "x")], "author string, created_utc bigint, body string")
    with pytest.raises(Exception, match="(?i)parquet|footer"):
        PO.recent_posts_cached(spark, posts, str(bad)).collect()
    assert PO.recent_posts_cached(spark, posts, str(tmp_path / "new")).count() == 1


def test_lookup_is_hinted_by_its_size(spark):
    df = spark.range(100).withColumnRenamed("id", "word")
    assert "broadcast" in sized_lookup(df)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in sized_lookup(df, max_bytes=10)._jdf.queryExecution().logical().toString().lower()
