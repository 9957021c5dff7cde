"""A training-corpus pipeline over ``documents``.

Every stage keeps the columns of ``documents``, whatever their names, and takes
null and empty texts, null ids, repeated rows and empty tables; texts are read
whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textprofile.llm import decontam, mixing, sharding, simhash, toxicity
from textprofile.llm.common import load, materialize
from textprofile.llm.queries import SHARDS, SIMHASH_RADIUS, SIMHASH_SHINGLE


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled examples call toxic go.  Texts without a
    marking term (empty ones too) score the share of toxic examples among such;
    without labelled rows nothing is known and the score is below the threshold."""
    index = toxicity.fit(docs, load(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, index, threshold=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest id, of rows
    without an id the smallest text hash.  Null, empty and blank texts are one
    group."""
    return simhash.drop_near_duplicates(docs, shingle=SIMHASH_SHINGLE, radius=SIMHASH_RADIUS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; null and empty texts and
    items without words match nothing."""
    return decontam.drop_contaminated(docs, load(spark, sf_dir, "benchmark"), similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeat or thin out to their target weights; a null source is one
    of its own, and a text without words has size 0."""
    return mixing.mix(docs, weights=(5, 2, 1), share=1.5, max_epochs=2, seed=7)


def place(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard; rows without an id by their other columns."""
    return sharding.assign_shards(docs, "doc_id", SHARDS)


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", place),
]

# Nearest neighbours, SimHash components and edit distances are beyond SQL here;
# tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's rows are written and read back."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
