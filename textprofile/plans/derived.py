"""Inputs derived from the driver's tables, each with its SQL twin.

The reference reads lexicons and corpora that are not shipped; the registered
queries derive stand-ins from the test tables so that their work grows with the
tables.  Every Spark derivation here has a DuckDB CTE of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize
from . import sqlfrag as S
from .tables import load

# Score names of the two word lexicons and the columns of the
# concept lexicon; they must equal the lexicons' own.
EMOTIONS = ("anger", "anticipation", "disgust", "fear", "joy", "negative",
            "positive", "sadness", "surprise", "trust")
VAD = ("valence", "arousal", "dominance")
AFFECT = ("pleasantness_value", "attention_value", "sensitivity_value",
          "aptitude_value", "polarity_value")
AFFECT_DESCRIPTIVE = ("primary_mood", "secondary_mood", "polarity_label",
                      "semantics1", "semantics2", "semantics3", "semantics4",
                      "semantics5")
CONCEPT_DIMS = 8


def hexint(col: Column, start: int, n: int) -> Column:
    """Integer from ``n`` hex digits of md5 starting at 1-based ``start``."""
    return F.conv(F.substring(F.md5(col), start, n), 16, 10).cast("bigint")


# ---- Spark side ------------------------------------------------------------

def bench_words(spark: SparkSession, sf: str) -> DataFrame:
    b = load(spark, sf, "benchmark")
    return b.select(F.explode(tokenize("text")).alias("word")).distinct()


def emotion_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    w = F.col("word")
    return bench_words(spark, sf).select(
        "word", *[(hexint(w, k + 1, 1) % 2).alias(e) for k, e in enumerate(EMOTIONS)])


def vad_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    w = F.col("word")
    return bench_words(spark, sf).select(
        "word", F.length(w).cast("bigint").alias("valence"),
        (hexint(w, 1, 2) % 7).alias("arousal"),
        (hexint(w, 3, 2) % 11 - 5).alias("dominance"))


def concept_vector_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    w = F.col("concept")
    return bench_words(spark, sf).select(F.col("word").alias("concept")).select(
        "concept", F.array(*[(hexint(w, 2 * k + 1, 2) % 9 - 4) for k in range(CONCEPT_DIMS)])
        .alias("vec"))


def hourglass_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """Five affect columns stored as text (cast strictly later) plus eight
    descriptive columns that the feature step drops."""
    w = F.col("concept")
    cols = [((hexint(w, 2 * k + 1, 2) % 5) - 2).cast("string").alias(a) for k, a in enumerate(AFFECT)]
    desc = [F.concat(F.lit(d + ":"), F.substring(F.md5(w), k + 1, 3)).alias(d)
            for k, d in enumerate(AFFECT_DESCRIPTIVE)]
    return bench_words(spark, sf).select(F.col("word").alias("concept")).select("concept", *cols, *desc)


# ---- SQL side (DuckDB CTE bodies) -------------------------------------------

SQL_BENCH_WORDS = f"SELECT DISTINCT unnest({S.tokens('text')}) AS word FROM benchmark"

SQL_EMOTION_LEX = ("SELECT word, " + ", ".join(
    f"{S.hexint('word', k + 1, 1)} % 2 AS {e}" for k, e in enumerate(EMOTIONS))
    + " FROM bench_words")

SQL_VAD_LEX = (f"SELECT word, length(word)::BIGINT AS valence, {S.hexint('word', 1, 2)} % 7 AS arousal, "
               f"{S.hexint('word', 3, 2)} % 11 - 5 AS dominance FROM bench_words")

SQL_CONCEPT_VEC = ("SELECT word AS concept, [" + ", ".join(
    f"{S.hexint('word', 2 * k + 1, 2)} % 9 - 4" for k in range(CONCEPT_DIMS)) + "] AS vec FROM bench_words")

SQL_HOURGLASS = ("SELECT word AS concept, " + ", ".join(
    f"(({S.hexint('word', 2 * k + 1, 2)} % 5) - 2)::VARCHAR AS {a}" for k, a in enumerate(AFFECT))
    + " FROM bench_words")


def with_ctes(**ctes: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items()) + "\n"
