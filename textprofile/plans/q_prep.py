"""Registered queries, step 2: recent posts, token shaping, readability, ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import batches as B
from ..functions import text as T
from ..functions.numeric import round_to
from ..functions import readability as RD
from ..operators import chunk as C
from ..operators import encoder as E
from ..operators import posts as P
from ..operators import readability as R
from ..operators.rank import global_position
from ..session import scratch_path
from ..sources import writers as WR
from ..streaming import posts as SP
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


# ---- recent posts ------------------------------------------------------------

@register("recent_posts",
          "WITH r AS (SELECT user_id, ts, event_id, event_type, row_number() OVER "
          "(PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) "
          "SELECT user_id, string_agg(event_type, ' ||| ' ORDER BY ts, event_id) AS text, "
          "count(*)::BIGINT AS n_posts FROM r WHERE rn <= 20 GROUP BY user_id")
def q_recent_posts(spark, sf):
    """Post log = events (author user_id, time ts, body event_type), n = 20."""
    ev = load(spark, sf, "events")
    return P.recent_posts(ev, n=20, author="user_id", ts="ts", body="event_type", tiebreak="event_id")


_SQL_RECENT = (
    "WITH r AS (SELECT user_id, ts, event_id, event_type, row_number() OVER "
    "(PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) "
    "SELECT user_id::VARCHAR AS author, string_agg(event_type, ' ||| ' ORDER BY ts, event_id) AS text, "
    "count(*)::BIGINT AS n_posts FROM r WHERE rn <= 20 GROUP BY user_id")


def _post_log(spark, sf):
    """``events`` as a post log: author, body, created_utc in microseconds, id."""
    return load(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("author"), F.col("event_type").alias("body"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("created_utc"), F.col("event_id").alias("id"))


@register("stream_recent_posts", _SQL_RECENT)
def q_stream_recent_posts(spark, sf):
    """The post log as a stream of CSV files whose posts are in no order of
    time, three files a micro-batch; the state after the last one."""
    path = scratch_path(spark, "post_files")
    WR.write_csv(_post_log(spark, sf).repartition(8, F.xxhash64("id")), path)
    state = SP.RecentPostsState(spark, scratch_path(spark, "recent_state"), n=20, tiebreak="id")
    SP.stream_recent_posts(spark, path, state, scratch_path(spark, "recent_ckpt"), keep={"id": "bigint"}, files_per_trigger=3)
    return state.texts()


@register("recent_posts_cache", _SQL_RECENT)
def q_recent_posts_cache(spark, sf):
    """Half of the post log through the cache, then the rest appended: the
    changed input is computed anew, and read from the cache after that."""
    log, path, root = _post_log(spark, sf), scratch_path(spark, "post_log"), scratch_path(spark, "post_cache")
    for part in (0, 1):
        log.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == part).write.mode("append").parquet(path)
        P.recent_posts_versioned(spark, spark.read.parquet(path), root, n=20, tiebreak="id")
    return P.recent_posts_versioned(spark, spark.read.parquet(path), root, n=20, tiebreak="id")


@register("recent_posts_conv",
          "WITH r AS (SELECT conv_id, turn, text, row_number() OVER "
          "(PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) "
          "SELECT conv_id, md5(string_agg(text, ' ||| ' ORDER BY turn)) AS digest, "
          "count(*)::BIGINT AS n_posts FROM r WHERE rn <= 3 GROUP BY conv_id")
def q_recent_posts_conv(spark, sf):
    conv = load(spark, sf, "conversations")
    out = P.recent_posts(conv, n=3, author="conv_id", ts="turn", body="text")
    return out.select("conv_id", F.md5("text").alias("digest"), "n_posts")


# ---- truncation, chunks, windows ------------------------------------------------

L = 64
_SQL_T = f"SELECT doc_id, {S.tokens('text')} AS toks FROM documents"


def _doc_tokens(spark, sf):
    return load(spark, sf, "documents").select("doc_id", T.tokenize("text").alias("toks"))


def _emit(df, arr):
    return df.select("doc_id", arr.alias("_a")).select(
        "doc_id", F.size("_a").cast("bigint").alias("n_tokens"),
        F.md5(F.array_join("_a", " ")).alias("digest"))


def _sql_emit(expr: str) -> str:
    return (f"WITH t AS ({_SQL_T}), a AS (SELECT doc_id, {expr} AS a FROM t) "
            "SELECT doc_id, len(a)::BIGINT AS n_tokens, md5(array_to_string(a, ' ')) AS digest FROM a")


@register("truncate_head", _sql_emit(f"list_slice(toks, 1, {L - 2})"))
def q_truncate_head(spark, sf):
    return _emit(_doc_tokens(spark, sf), C.truncate_head("toks", L))


@register("truncate_tail", _sql_emit(
    f"CASE WHEN len(toks) > {L - 2} THEN list_slice(toks, len(toks) - {L - 3}, len(toks)) ELSE toks END"))
def q_truncate_tail(spark, sf):
    return _emit(_doc_tokens(spark, sf), C.truncate_tail("toks", L))


HEAD_N, TAIL_N = L // 2, L // 2 - 2


@register("truncate_head_tail", _sql_emit(
    f"CASE WHEN len(toks) <= {HEAD_N + TAIL_N} THEN toks ELSE "
    f"list_concat(list_slice(toks, 1, {HEAD_N}), list_slice(toks, len(toks) - {TAIL_N - 1}, len(toks))) END"))
def q_truncate_head_tail(spark, sf):
    return _emit(_doc_tokens(spark, sf), C.truncate_head_tail("toks", HEAD_N, TAIL_N))


def _chunk_out(df):
    return df.select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"),
                     F.size("chunk").cast("bigint").alias("n_tokens"),
                     F.element_at("chunk", 1).alias("first_token"))


def _sql_chunks(count_expr: str, step: int, size: int) -> str:
    return (f"WITH t AS ({_SQL_T}), c AS (SELECT doc_id, toks, {count_expr} AS nc FROM t), "
            "e AS (SELECT doc_id, toks, unnest(range(0, nc)) AS chunk_no FROM c), "
            f"s AS (SELECT doc_id, chunk_no, list_slice(toks, chunk_no * {step} + 1, chunk_no * {step} + {size}) AS ch FROM e) "
            "SELECT doc_id, chunk_no::BIGINT AS chunk_no, len(ch)::BIGINT AS n_tokens, ch[1] AS first_token FROM s")


@register("chunk_fixed", _sql_chunks(f"least(ceil(len(toks) / {L}), 4)::BIGINT", L, L))
def q_chunk_fixed(spark, sf):
    return _chunk_out(C.chunk_fixed(_doc_tokens(spark, sf), "toks", size=L, max_chunks=4))


@register("chunk_fixed_all", _sql_chunks(f"ceil(len(toks) / {L})::BIGINT", L, L))
def q_chunk_fixed_all(spark, sf):
    """Fixed chunks without a limit: every token is in one."""
    return _chunk_out(C.chunk_fixed(_doc_tokens(spark, sf), "toks", size=L))


OVERLAP = 16


@register("chunk_overlap", _sql_chunks(
    f"(CASE WHEN len(toks) = 0 THEN 0 WHEN len(toks) <= {L} THEN 1 "
    f"ELSE ceil((len(toks) - {L}) / {L - OVERLAP}) + 1 END)::BIGINT", L - OVERLAP, L))
def q_chunk_overlap(spark, sf):
    return _chunk_out(C.chunk_overlap(_doc_tokens(spark, sf), "toks", size=L, overlap=OVERLAP))


# ---- vocabulary and ids ----------------------------------------------------------

_SQL_LOWER_TOK = f"SELECT doc_id, unnest({S.tokens('lower(text)')}) AS word FROM documents"
_SQL_VOCAB = (f"SELECT word, (row_number() OVER (ORDER BY cnt DESC, word ASC) + {C.FIRST_WORD_ID - 1})::BIGINT AS id, "
              f"cnt::BIGINT AS cnt FROM (SELECT word, count(*) AS cnt FROM ({_SQL_LOWER_TOK}) GROUP BY word)")


def _vocab(spark, sf):
    docs = load(spark, sf, "documents")
    rows = docs.select(F.inline(B.word_counts(T.tokenize_batches(F.lower("text")))))
    return C.build_vocab(rows, count="n")


@register("vocab_build", _SQL_VOCAB)
def q_vocab_build(spark, sf):
    return _vocab(spark, sf)


@register("word_ids", D.with_ctes(
    vocab=_SQL_VOCAB,
    t=f"SELECT doc_id, list_slice({S.tokens('lower(text)')}, 1, {L - 2}) AS toks FROM documents",
    body="SELECT doc_id, unnest(range(1, len(toks) + 1)) AS pos, unnest(toks) AS word FROM t",
    ids=f"SELECT body.doc_id, body.pos, coalesce(vocab.id, {C.UNK_ID}) AS id FROM body LEFT JOIN vocab ON body.word = vocab.word",
    allrows=f"SELECT doc_id, pos, id FROM ids UNION ALL SELECT doc_id, 0, {C.START_ID} FROM t "
            f"UNION ALL SELECT doc_id, len(toks) + 1, {C.END_ID} FROM t "
            f"UNION ALL SELECT doc_id, unnest(range(len(toks) + 2, {L})), {C.PAD_ID} FROM t")
    + "SELECT doc_id, pos::BIGINT AS pos, id::BIGINT AS id FROM allrows")
def q_word_ids(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", T.tokenize(F.lower(F.col("text"))).alias("toks"))
    enc = C.encode_ids(docs, "toks", _vocab(spark, sf), L)
    return enc.select("doc_id", F.posexplode("ids").alias("pos", "id")).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("id").cast("bigint").alias("id"))


@register("embed_ids", D.with_ctes(
    vocab=_SQL_VOCAB, t=f"SELECT doc_id, {S.tokens('lower(text)')} AS toks FROM documents",
    body="SELECT doc_id, unnest(toks) AS word FROM t",
    ids=f"SELECT body.doc_id, coalesce(vocab.id, {C.UNK_ID}) AS id FROM body LEFT JOIN vocab ON body.word = vocab.word "
        f"UNION ALL SELECT doc_id, {C.START_ID} FROM t UNION ALL SELECT doc_id, {C.END_ID} FROM t")
    + "SELECT doc_id, layer::BIGINT AS layer, (d - 1)::BIGINT AS dim, round(avg((id * 7 * d + 13 * layer) % 101), 6) AS value "
      "FROM ids, (SELECT unnest([1, 2]) AS layer) l, (SELECT unnest(range(1, 9)) AS d) dd GROUP BY 1, 2, 3")
def q_embed_ids(spark, sf):
    """Ids of whole documents through an encoder that takes id matrices with a
    mask: batches of like lengths under a token budget, mean over the mask."""
    docs = load(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"))
    blocks = C.word_blocks(docs, "text")
    ids = C.block_id_lists(blocks, C.build_vocab(C.block_words(blocks), count="n"))
    long = E.embed_ids(ids, "ids", "demo_ids").select("doc_id", "layer", F.posexplode("vec").alias("dim", "value"))
    return long.select("doc_id", F.col("layer").cast("bigint").alias("layer"), F.col("dim").cast("bigint").alias("dim"), r6("value").alias("value"))


# ---- readability -------------------------------------------------------------------

_SQL_EASY = (f"SELECT DISTINCT {S.rd_letters_lower('w')} AS word FROM "
             f"(SELECT unnest({S.tokens('text')}) AS w FROM benchmark)")


def easy_words(spark, sf):
    b = load(spark, sf, "benchmark")
    return (b.select(F.explode(T.tokenize("text")).alias("w"))
            .select(RD.letters_lower(F.col("w")).alias("word")).distinct())


def _readability(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text")
    return R.readability(docs, easy_words(spark, sf))


_SQL_EN = "SELECT doc_id, text FROM documents"
_SQL_DC = (f"SELECT d.doc_id, sum(CASE WHEN w.lw IS NOT NULL AND e.word IS NULL THEN 1 ELSE 0 END)::BIGINT AS complex_words_dc "
           f"FROM en d LEFT JOIN (SELECT doc_id, {S.rd_letters_lower('w0')} AS lw FROM "
           f"(SELECT doc_id, unnest({S.rd_words('text')}) AS w0 FROM en)) w ON d.doc_id = w.doc_id "
           "LEFT JOIN easy e ON w.lw = e.word GROUP BY d.doc_id")
_SQL_COUNTS = ("SELECT en.doc_id, " + ", ".join(f"{v} AS {k}" for k, v in S.rd_counts("text").items())
               + ", dc.complex_words_dc FROM en JOIN dc ON en.doc_id = dc.doc_id")


@register("readability_counts", D.with_ctes(en=_SQL_EN, easy=_SQL_EASY, dc=_SQL_DC, c=_SQL_COUNTS)
          + "SELECT * FROM c")
def q_readability_counts(spark, sf):
    return _readability(spark, sf).select("doc_id", *RD.COUNT_COLUMNS, "complex_words_dc")


def _sql_grades() -> str:
    def d(a, b):
        return f"(({a})::DOUBLE / nullif({b}, 0))"
    wps = d("words", "sentences")
    dc = d("complex_words_dc", "words")
    g = {
        "characters_per_word": d("characters", "words"),
        "syll_per_word": d("syllables", "words"),
        "words_per_sentence": wps,
        "sentences_per_paragraph": d("sentences", "paragraphs"),
        "type_token_ratio": d("wordtypes", "words"),
        "kincaid": f"11.8 * {d('syllables', 'words')} + 0.39 * {wps} - 15.59",
        "ari": f"4.71 * {d('characters', 'words')} + 0.5 * {wps} - 21.43",
        "coleman_liau": f"5.879851 * {d('characters', 'words')} - 29.587280 * {d('sentences', 'words')} - 15.800804",
        "flesch_reading_ease": f"206.835 - 84.6 * {d('syllables', 'words')} - 1.015 * {wps}",
        "gunning_fog_index": f"0.4 * ({wps} + 100 * {d('complex_words', 'words')})",
        "lix": f"{wps} + 100 * {d('long_words', 'words')}",
        "smog_index": f"sqrt({d('complex_words * 30', 'sentences')}) + 3",
        "rix": d("long_words", "sentences"),
        "dale_chall_index": f"15.79 * {dc} + 0.0496 * {wps} + CASE WHEN {dc} > 0.05 THEN 3.6365 ELSE 0.0 END",
    }
    return "SELECT doc_id, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in g.items()) + " FROM c"


@register("readability_grades", D.with_ctes(en=_SQL_EN, easy=_SQL_EASY, dc=_SQL_DC, c=_SQL_COUNTS)
          + _sql_grades())
def q_readability_grades(spark, sf):
    return _readability(spark, sf).select(
        "doc_id", *[r6(c).alias(c) for c in RD.RATIO_COLUMNS + RD.GRADE_COLUMNS])


@register("readability_usage", f"WITH en AS ({_SQL_EN}) SELECT doc_id, "
          + ", ".join(f"{v} AS {k}" for k, v in S.rd_usage("text").items()) + " FROM en")
def q_readability_usage(spark, sf):
    return _readability(spark, sf).select("doc_id", *RD.USAGE_COLUMNS, *RD.BEGIN_COLUMNS)


_COMPAT = {"tobeverb": "use_tobeverb", "auxverb": "use_auxverb", "nominalization": "use_nominalization",
           "pronoun": "begin_pronoun", "interrogative": "begin_interrogative", "article": "begin_article",
           "subordination": "begin_subordination", "conjunction": "begin_conjunction",
           "preposition": "begin_preposition"}


@register("readability_compat", f"WITH en AS ({_SQL_EN}) SELECT doc_id, "
          + ", ".join(f"{S.rd_usage('text')[v]} AS {k}" for k, v in _COMPAT.items()) + " FROM en")
def q_readability_compat(spark, sf):
    """Flattened-the-old-way names: the usage counts of pronoun, conjunction
    and preposition are overwritten by the sentence-beginning counts."""
    docs = load(spark, sf, "documents").select("doc_id", "text")
    return R.readability(docs, easy_words(spark, sf), compat=True).select("doc_id", *_COMPAT)


# ---- length ordering -------------------------------------------------------------------

_SQL_DL = (f"SELECT d.doc_id, len({S.tokens('d.text')})::BIGINT AS n_tokens, l.quality, l.toxic "
           "FROM documents d JOIN labels l ON d.doc_id = l.doc_id")


def doc_lengths(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", F.size(T.tokenize("text")).cast("bigint").alias("n_tokens"))
    return docs.join(load(spark, sf, "labels"), "doc_id")


@register("length_order", f"WITH dl AS ({_SQL_DL}) SELECT doc_id, n_tokens, "
          "(row_number() OVER (ORDER BY n_tokens, doc_id) - 1)::BIGINT AS ord FROM dl")
def q_length_order(spark, sf):
    """Author order after the (token length, author) sort; the position is a
    distributed global rank."""
    ranked = global_position(doc_lengths(spark, sf), ["n_tokens", "doc_id"], name="ord")
    return ranked.select("doc_id", "n_tokens", "ord")


@register("mean_token_length", f"WITH dl AS ({_SQL_DL}) SELECT round(avg(n_tokens), 6) AS mean_len, "
          "floor(avg(n_tokens))::BIGINT AS mean_len_int FROM dl")
def q_mean_token_length(spark, sf):
    return doc_lengths(spark, sf).agg(r6(F.avg("n_tokens")).alias("mean_len"),
                                      F.floor(F.avg("n_tokens")).cast("bigint").alias("mean_len_int"))
