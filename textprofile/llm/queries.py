"""The registered queries of the numbered operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, exact_dedup, licenses, mixing, pii, quality, repair, sharding, simhash, suffix_dedup, toxicity, whitening
from .common import in_fold, load

SHARDS = [f"shard-{i:03d}" for i in range(16)]
SIMHASH_SHINGLE, SIMHASH_RADIUS = 3, 2


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    # whole rows: one without doc_id is placed by the hash of its other columns
    docs = load(spark, sf_dir, "documents")
    return sharding.assign_shards(docs, "doc_id", SHARDS, slot_col="slot").select("doc_id", "slot", "shard")


def _scored(out: DataFrame, mod: int, rest: int) -> DataFrame:
    return out.select("doc_id", in_fold(F.col("doc_id"), mod, rest).alias("held_out"),
                      *[c for c in out.columns if c != "doc_id"])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    index = toxicity.fit(docs, labels.filter(~in_fold(F.col("doc_id"), 5, 0)))
    return _scored(toxicity.score(docs, index), 5, 0)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return pii.find_personal_data(docs, pii.fit(docs))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(~in_fold(F.col("doc_id"), 4, 2)))
    return _scored(quality.score(docs, model, threshold=0.7), 4, 2)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(load(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.format_windows(turns.unionByName(chat.probe(spark))))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(load(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, max_epochs=2, seed=7)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(load(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(load(spark, sf_dir, "documents"), shingle=SIMHASH_SHINGLE, radius=SIMHASH_RADIUS)
    return out.select("doc_id", "fingerprint", "component_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_passages(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), similarity=0.8)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.substring_dedup(load(spark, sf_dir, "documents"), threshold=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damaged_and_repaired(load(spark, sf_dir, "conversations"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(whitening.fit(load(spark, sf_dir, "embeddings")), spark, components=8)


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_toxicity": op2_toxicity,
    "op3_pii": op3_pii,
    "op4_quality": op4_quality,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_chat": op6_chat,
    "op7_mixing": op7_mixing,
    "op8_licenses": op8_licenses,
    "op9_simhash": op9_simhash,
    "op10_decontamination": op10_decontamination,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_repair": op12_repair,
    "op13_whitening": op13_whitening,
}

ORACLE = {
    "op1_sharding": sharding.oracle(SHARDS, sharding.table_size_for(len(SHARDS))),
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op6_chat": chat.ORACLE,
    "op7_mixing": mixing.ORACLE,
}
