"""Structured Streaming: lexicon features and trait scores for a stream of texts.

Each document is one row and never spans micro-batches, so the per-document
aggregates inside ``foreachBatch`` are exact; the results are appended to a
Parquet sink with the batch id, which makes a replayed batch (after a
failure) idempotent through ``batch_id`` partition overwrite semantics.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lexicon as LX
from ..operators.joins import sized_lookup

# Default bound of a micro-batch, in source files.
FILES_PER_TRIGGER = 64


def text_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """File stream of Parquet text tables (explicit schema, bounded batches)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_to_sink(stream: DataFrame, per_batch: Callable[[DataFrame], DataFrame], sink: str,
                checkpoint: str, available_now: bool = True, name: str | None = None) -> None:
    """Run ``per_batch`` on every micro-batch and append to ``sink``.  With
    ``available_now`` the query processes what is there and stops."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        out = per_batch(batch).withColumn("batch_id", F.lit(batch_id))
        # dynamic partition overwrite: a retried batch replaces its own files
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy("batch_id").parquet(sink)

    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if name:
        w = w.queryName(name)
    q = w.trigger(availableNow=True).start() if available_now else w.start()
    if available_now:
        q.awaitTermination()


def lexicon_stream(spark: SparkSession, source: str, schema: str, lexicon: DataFrame, scores: Sequence[str],
                   sink: str, checkpoint: str, doc_key: str = "doc_id", text_col: str = "text",
                   files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """Weighted lexicon means for a stream of documents (stream-static join
    inside each micro-batch).  The lexicon is written once to the shared folder
    and its size checked once before the stream starts; every micro-batch joins
    that fixed table.  ``files_per_trigger`` bounds a batch.  Returns the sink as
    a batch DataFrame."""
    lex = sized_lookup(lexicon.select("word", *scores))

    def per_batch(b: DataFrame) -> DataFrame:
        return LX.lexicon_features(b.select(doc_key, text_col), lex, scores, doc_key=doc_key,
                                   text_col=text_col, presized=True)

    run_to_sink(text_stream(spark, source, schema, files_per_trigger), per_batch, sink, checkpoint)
    return spark.read.parquet(sink).drop("batch_id")


def score_stream(spark: SparkSession, source: str, schema: str,
                 featurize: Callable[[DataFrame], DataFrame], models: dict, sink: str, checkpoint: str,
                 doc_key: str = "doc_id", files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """Score a stream of texts with saved per-trait models: ``featurize`` maps
    a batch of ``(doc_key, text)`` to ``(doc_key, features)``."""
    from ..operators.models import score

    def per_batch(b: DataFrame) -> DataFrame:
        return score(featurize(b), models, key=doc_key)

    run_to_sink(text_stream(spark, source, schema, files_per_trigger), per_batch, sink, checkpoint)
    return spark.read.parquet(sink).drop("batch_id")
