"""Registered queries, step 1: cleaning, tokens, lexicon features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numeric import round_to
from ..operators import lexicon as L
from . import derived as D
from . import sqlfrag as S
from .tables import load

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c):
    return round_to(c, 6)


# ---- cleaning --------------------------------------------------------------

def _dirty_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a page URL, the post separator and social artefacts
    appended (the plain test texts hold none)."""
    docs = load(spark, sf, "documents").select("doc_id", "text")
    pages = load(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url")
    return docs.join(pages, "doc_id", "left").select(
        "doc_id",
        F.concat_ws(" ", "text", "url", F.lit("  |||  @user_"), F.col("doc_id").cast("string"),
                    F.lit("#tag :) 42 RT"), F.lit("x  b   end")).alias("text"))


_SQL_DIRTY = ("SELECT d.doc_id, concat_ws(' ', d.text, p.url, '  |||  @user_', d.doc_id::VARCHAR, "
              "'#tag :) 42 RT', 'x  b   end') AS text "
              "FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id")


def _digest(df: DataFrame, expr) -> DataFrame:
    return df.select("doc_id", expr.alias("_c")).select(
        "doc_id", F.length("_c").cast("bigint").alias("n_chars"), F.md5("_c").alias("digest"))


def _sql_digest(expr: str) -> str:
    return (f"WITH dirty AS ({_SQL_DIRTY}), c AS (SELECT doc_id, {expr} AS c FROM dirty) "
            "SELECT doc_id, length(c)::BIGINT AS n_chars, md5(c) AS digest FROM c")


@register("clean_text", _sql_digest(S.clean_text("text")))
def q_clean_text(spark, sf):
    return _digest(_dirty_docs(spark, sf), T.clean_text("text"))


@register("clean_strict", _sql_digest(S.clean_strict("text")))
def q_clean_strict(spark, sf):
    return _digest(_dirty_docs(spark, sf), T.clean_strict("text"))


@register("clean_social", _sql_digest(S.clean_social("text")))
def q_clean_social(spark, sf):
    return _digest(_dirty_docs(spark, sf), T.clean_social("text"))


# ---- tokens ------------------------------------------------------------------

_SQL_TOK = f"SELECT doc_id, unnest({S.tokens('text')}) AS word FROM documents"


@register("token_counts", f"WITH tok AS ({_SQL_TOK}) "
          "SELECT doc_id, word, count(*)::BIGINT AS cnt FROM tok GROUP BY doc_id, word")
def q_token_counts(spark, sf):
    return L.token_counts(load(spark, sf, "documents"))


@register("sentence_split", f"SELECT doc_id, len({S.sentences('text')})::BIGINT AS n_sentences "
          "FROM documents")
def q_sentence_split(spark, sf):
    docs = load(spark, sf, "documents")
    return docs.select("doc_id", F.size(T.sentences("text")).cast("bigint").alias("n_sentences"))


@register("token_preview",
          f"WITH first_docs AS (SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 10), "
          f"t AS (SELECT doc_id, {S.tokens('text')} AS toks FROM first_docs), "
          "u AS (SELECT doc_id, unnest(range(0, least(len(toks), 10))) AS pos, toks FROM t) "
          "SELECT doc_id, pos::BIGINT AS pos, toks[pos + 1] AS token FROM u")
def q_token_preview(spark, sf):
    """Preview: first 10 tokens of the first 10 documents (the limit is the
    feature; it is planned as a top-k, not a sort of the corpus)."""
    docs = load(spark, sf, "documents").orderBy("doc_id").limit(10)
    return docs.select("doc_id", F.posexplode(F.slice(T.tokenize("text"), 1, 10)).alias("pos", "token")) \
        .select("doc_id", F.col("pos").cast("bigint").alias("pos"), "token")


# ---- lexicon features --------------------------------------------------------

def _sql_lexicon_mean(lex_cte: str, scores) -> str:
    ctes = D.with_ctes(bench_words=D.SQL_BENCH_WORDS, lex=lex_cte, tok=_SQL_TOK,
                       hit=f"SELECT tok.doc_id, {', '.join('lex.' + s for s in scores)} "
                           "FROM tok JOIN lex ON tok.word = lex.word",
                       agg="SELECT doc_id, " + ", ".join(
                           f"sum({s})::DOUBLE / count(*) AS {s}" for s in scores)
                           + " FROM hit GROUP BY doc_id")
    return ctes + "SELECT d.doc_id, " + ", ".join(f"round(agg.{s}, 6) AS {s}" for s in scores) + \
        " FROM documents d LEFT JOIN agg ON d.doc_id = agg.doc_id"


@register("lexicon_emotion", _sql_lexicon_mean(D.SQL_EMOTION_LEX, D.EMOTIONS))
def q_lexicon_emotion(spark, sf):
    out = L.lexicon_features(load(spark, sf, "documents"), D.emotion_lexicon(spark, sf), D.EMOTIONS)
    return out.select("doc_id", *[r6(s).alias(s) for s in D.EMOTIONS])


@register("lexicon_vad", _sql_lexicon_mean(D.SQL_VAD_LEX, D.VAD))
def q_lexicon_vad(spark, sf):
    out = L.lexicon_features(load(spark, sf, "documents"), D.vad_lexicon(spark, sf), D.VAD)
    return out.select("doc_id", *[r6(s).alias(s) for s in D.VAD])


_SQL_BAG = f"WITH tok AS ({_SQL_TOK}) SELECT doc_id, word AS concept, count(*) AS cnt FROM tok GROUP BY 1, 2"


def doc_bags(spark, sf) -> DataFrame:
    return L.concept_bag(load(spark, sf, "documents"))


@register("concept_bag_explode", f"SELECT doc_id, concept, cnt::BIGINT AS count FROM ({_SQL_BAG})")
def q_concept_bag_explode(spark, sf):
    return L.explode_concepts(doc_bags(spark, sf))


@register("lexicon_concept_vectors", D.with_ctes(
    bench_words=D.SQL_BENCH_WORDS, lex=D.SQL_CONCEPT_VEC, bag=_SQL_BAG,
    hit="SELECT bag.doc_id, bag.cnt, lex.vec FROM bag JOIN lex ON bag.concept = lex.concept",
    el="SELECT doc_id, cnt, unnest(range(0, len(vec))) AS dim, unnest(vec) AS x FROM hit",
    agg="SELECT doc_id, dim, sum(x * cnt)::DOUBLE / sum(cnt) AS value FROM el GROUP BY 1, 2")
    + "SELECT d.doc_id, agg.dim::BIGINT AS dim, round(agg.value, 6) AS value "
      "FROM documents d LEFT JOIN agg ON d.doc_id = agg.doc_id")
def q_lexicon_concept_vectors(spark, sf):
    out = L.concept_vector_features(doc_bags(spark, sf), D.concept_vector_lexicon(spark, sf))
    return out.select("doc_id", F.col("dim").cast("bigint").alias("dim"), r6("value").alias("value"))


def read_affect_lexicon(raw: DataFrame) -> DataFrame:
    """Concept-affect lexicon: drop the descriptive columns, strict numeric cast
    (ANSI: a non-numeric cell raises)."""
    return raw.drop(*D.AFFECT_DESCRIPTIVE).select(
        "concept", *[F.col(a).cast("double").alias(a) for a in D.AFFECT])


@register("lexicon_hourglass", D.with_ctes(
    bench_words=D.SQL_BENCH_WORDS, lex=D.SQL_HOURGLASS, bag=_SQL_BAG,
    agg="SELECT bag.doc_id, " + ", ".join(
        f"sum(lex.{a}::DOUBLE * bag.cnt) / sum(bag.cnt) AS {a}" for a in D.AFFECT)
        + " FROM bag JOIN lex ON bag.concept = lex.concept GROUP BY bag.doc_id")
    + "SELECT d.doc_id, " + ", ".join(f"round(agg.{a}, 6) AS {a}" for a in D.AFFECT)
    + " FROM documents d LEFT JOIN agg ON d.doc_id = agg.doc_id")
def q_lexicon_hourglass(spark, sf):
    lex = read_affect_lexicon(D.hourglass_lexicon(spark, sf))
    out = L.concept_features(doc_bags(spark, sf), lex, D.AFFECT)
    return out.select("doc_id", *[r6(a).alias(a) for a in D.AFFECT])


@register("lexicon_coverage", D.with_ctes(
    bench_words=D.SQL_BENCH_WORDS, tok=_SQL_TOK,
    w="SELECT DISTINCT doc_id, word FROM tok",
    agg="SELECT w.doc_id, count(*) AS n_words, count(b.word) AS n_hits "
        "FROM w LEFT JOIN bench_words b ON w.word = b.word GROUP BY w.doc_id")
    + "SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_hits, 0)::BIGINT AS n_hits, "
      "round(n_hits::DOUBLE / n_words, 6) AS coverage FROM documents d LEFT JOIN agg ON d.doc_id = agg.doc_id")
def q_lexicon_coverage(spark, sf):
    out = L.lexicon_coverage(load(spark, sf, "documents"), D.emotion_lexicon(spark, sf))
    return out.select("doc_id", "n_words", "n_hits", r6("coverage").alias("coverage"))
