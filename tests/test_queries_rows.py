"""Rows-only queries: shapes and invariants on the smallest tables."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def test_score_and_stream_score_agree_on_shape(spark):
    qs = E.queries()
    batch = qs["score_unseen"](spark, SF_SMALL)
    stream = qs["stream_score"](spark, SF_SMALL)
    n_docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    assert batch.count() == stream.count() == 2 * n_docs
    bad = batch.filter(F.col("decision").isNotNull() & ~F.col("decision").isin("Yes", "No")).count()
    assert bad == 0
    # same featurisation and the same (deterministic) models: identical scores
    a = {(r.doc_id, r.trait): r.probability for r in batch.collect()}
    b = {(r.doc_id, r.trait): r.probability for r in stream.collect()}
    assert a == b


def test_readability_compat_names(spark):
    out = E.queries()["readability_compat"](spark, SF_SMALL)
    assert out.columns == ["doc_id", "tobeverb", "auxverb", "nominalization", "pronoun", "interrogative",
                           "article", "subordination", "conjunction", "preposition"]


def test_cv_results_shape(spark):
    rows = E.queries()["cv_results"](spark, SF_SMALL).collect()
    assert sorted((r.trait, r.fold) for r in rows) == sorted((t, f) for t in ("odd", "low") for f in range(1, 11))
