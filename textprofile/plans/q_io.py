"""Registered queries, step 3: sources/sinks round trips, label plumbing,
feature joins, z-score, assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numeric import round_to
from ..operators import features as FE
from ..operators import lexicon as LX
from ..operators import moments as MO
from ..operators.rank import global_position
from ..session import scratch_path
from ..sources import readers as RD
from ..sources import writers as WR
from . import derived as D
from . import q_prep, q_text
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


# ---- derived label strings (same rules in SQL) ---------------------------------------

def yn_strings(lab):
    """Five y/n trait strings derived from the label bits (mixed case, some
    non-``y`` junk, to exercise the encoder)."""
    d = F.col("doc_id")
    return lab.select(
        "doc_id",
        F.when(F.col("quality") == 1, "y").otherwise("n").alias("cEXT"),
        F.when(F.col("toxic") == 1, "Y").otherwise("N").alias("cNEU"),
        F.when(d % 2 == 0, "y").otherwise("x").alias("cAGR"),
        F.when(d % 3 == 0, "Y").otherwise("n").alias("cCON"),
        F.when(F.col("quality") + F.col("toxic") == 1, "y").otherwise("no").alias("cOPN"))


SQL_YN_FLAGS = ("SELECT doc_id, quality::BIGINT AS EXT, toxic::BIGINT AS NEU, (doc_id % 2 = 0)::BIGINT AS AGR, "
                "(doc_id % 3 = 0)::BIGINT AS CON, (quality + toxic = 1)::BIGINT AS OPN FROM labels")


def type_codes(lab):
    """Four-letter type code from label bits; every fifth code lower-case (so
    the case-sensitive letters score 0)."""
    d = F.col("doc_id")
    code = F.concat(F.when(F.col("quality") == 1, "E").otherwise("I"),
                    F.when(F.col("toxic") == 1, "N").otherwise("S"),
                    F.when(d % 2 == 0, "F").otherwise("T"),
                    F.when(d % 3 == 0, "J").otherwise("P"))
    return lab.select("doc_id", F.when(d % 5 == 0, F.lower(code)).otherwise(code).alias("type"))


SQL_CODES = ("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN lower(c) ELSE c END AS type FROM ("
             "SELECT doc_id, (CASE WHEN quality = 1 THEN 'E' ELSE 'I' END) || (CASE WHEN toxic = 1 THEN 'N' ELSE 'S' END) "
             "|| (CASE WHEN doc_id % 2 = 0 THEN 'F' ELSE 'T' END) || (CASE WHEN doc_id % 3 = 0 THEN 'J' ELSE 'P' END) AS c "
             "FROM labels)")
SQL_CODE_FLAGS = ("SELECT doc_id, (doc_id % 5 <> 0 AND quality = 1)::BIGINT AS E, (doc_id % 5 <> 0 AND toxic = 1)::BIGINT AS N, "
                  "(doc_id % 5 <> 0 AND doc_id % 2 = 0)::BIGINT AS F, (doc_id % 5 <> 0 AND doc_id % 3 = 0)::BIGINT AS J FROM labels")


# ---- label encoders --------------------------------------------------------------------

@register("label_encode_yn", SQL_YN_FLAGS)
def q_label_encode_yn(spark, sf):
    s = yn_strings(load(spark, sf, "labels"))
    return s.select("doc_id", *[T.yes_no_flag(f"c{t}").cast("bigint").alias(t) for t in RD.FIVE_TRAITS])


@register("label_encode_code", SQL_CODE_FLAGS)
def q_label_encode_code(spark, sf):
    s = type_codes(load(spark, sf, "labels"))
    return s.select("doc_id", *[T.code_letter_flag("type", p, l).cast("bigint").alias(l)
                                for l, p in RD.CODE_LETTERS])


@register("onehot_target",
          "SELECT doc_id, 'quality' AS trait, (1 - quality)::BIGINT AS y0, quality::BIGINT AS y1 FROM labels "
          "UNION ALL SELECT doc_id, 'toxic', (1 - toxic)::BIGINT, toxic::BIGINT FROM labels")
def q_onehot_target(spark, sf):
    long = load(spark, sf, "labels").unpivot(["doc_id"], ["quality", "toxic"], "trait", "label")
    oh = F.array(1 - F.col("label"), F.col("label"))
    return long.select("doc_id", "trait", oh[0].cast("bigint").alias("y0"), oh[1].cast("bigint").alias("y1"))


_BOOL_WORDS = ("true", "F", "yes", "n", "1", "0", "T", "No")


@register("parse_bool",
          "WITH w AS (SELECT doc_id, (" + "[" + ", ".join(S.q(x) for x in _BOOL_WORDS) + "])[doc_id % 8 + 1] AS word FROM labels) "
          "SELECT doc_id, word, CASE WHEN lower(word) IN " + S._in(T.FALSE_WORDS) + " THEN false "
          "WHEN lower(word) IN " + S._in(T.TRUE_WORDS) + " THEN true END AS b FROM w")
def q_parse_bool(spark, sf):
    words = F.array(*[F.lit(x) for x in _BOOL_WORDS])
    w = load(spark, sf, "labels").select("doc_id", F.element_at(words, (F.col("doc_id") % 8 + 1).cast("int")).alias("word"))
    return w.select("doc_id", "word", T.parse_bool("word").alias("b"))


@register("numeric_coerce",
          "SELECT page_id, string_split(url, '/')[-1] AS segment, TRY_CAST(trim(string_split(url, '/')[-1]) AS DOUBLE) AS value FROM pages")
def q_numeric_coerce(spark, sf):
    p = load(spark, sf, "pages").select("page_id", F.element_at(F.split("url", "/"), -1).alias("segment"))
    return p.select("page_id", "segment", T.numeric_or_null(F.trim("segment")).alias("value"))


@register("normalize_id",
          "WITH r AS (SELECT page_id, '''dir\\\\' || CASE WHEN page_id % 5 = 0 THEN 'idx_' ELSE 'id_' END || page_id::VARCHAR || '''' AS raw FROM pages) "
          "SELECT page_id, raw, TRY_CAST(replace(string_split(replace(raw, '''', ''), '\\\\')[-1], 'id_', '') AS BIGINT) AS idx FROM r")
def q_normalize_id(spark, sf):
    p = load(spark, sf, "pages").select("page_id", F.concat(
        F.lit("'dir\\\\"), F.when(F.col("page_id") % 5 == 0, "idx_").otherwise("id_"),
        F.col("page_id").cast("string"), F.lit("'")).alias("raw"))
    return p.select("page_id", "raw", T.normalize_author_id("raw").alias("idx"))


@register("targets_unpivot",
          "SELECT doc_id, 'quality' AS trait, quality::BIGINT AS label FROM labels "
          "UNION ALL SELECT doc_id, 'toxic', toxic::BIGINT FROM labels")
def q_targets_unpivot(spark, sf):
    lab = load(spark, sf, "labels")
    return lab.select("doc_id", F.col("quality").cast("bigint"), F.col("toxic").cast("bigint")) \
        .unpivot(["doc_id"], ["quality", "toxic"], "trait", "label")


@register("label_distribution",
          "SELECT trait, label, count(*)::BIGINT AS n FROM (SELECT 'quality' AS trait, quality::BIGINT AS label FROM labels "
          "UNION ALL SELECT 'toxic', toxic::BIGINT FROM labels) GROUP BY trait, label")
def q_label_distribution(spark, sf):
    long = q_targets_unpivot(spark, sf)
    return long.groupBy("trait", "label").agg(F.count(F.lit(1)).alias("n"))


# ---- round trips through files ---------------------------------------------------------------



@register("src_corpus_csv", D.with_ctes(yn=SQL_YN_FLAGS) +
          "SELECT d.doc_id::VARCHAR AS user, length(d.text)::BIGINT AS n_chars, md5(d.text) AS digest, "
          f"len({S.tokens('d.text')})::BIGINT AS token_len, yn.EXT, yn.NEU, yn.AGR, yn.CON, yn.OPN "
          "FROM documents d JOIN yn ON d.doc_id = yn.doc_id")
def q_src_corpus_csv(spark, sf):
    """Five-trait corpus written as CSV (header, quoted multi-line text, y/n
    columns) and read back by position."""
    docs = load(spark, sf, "documents").select("doc_id", "text")
    yn = yn_strings(load(spark, sf, "labels"))
    out = docs.join(yn, "doc_id").select(F.col("doc_id").cast("string").alias("#AUTHID"),
                                         F.col("text").alias("TEXT"), "cEXT", "cNEU", "cAGR", "cCON", "cOPN")
    path = scratch_path(spark, "corpus_csv")
    WR.write_csv(out, path)
    back = RD.read_trait_corpus(spark, path)
    return back.select("user", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"),
                       F.col("token_len").cast("bigint").alias("token_len"),
                       *[F.col(t).cast("bigint").alias(t) for t in RD.FIVE_TRAITS])


@register("src_type_csv", D.with_ctes(codes=SQL_CODES, fl=SQL_CODE_FLAGS) +
          "SELECT d.doc_id::VARCHAR AS user, md5(d.text) AS digest, fl.E, fl.N, fl.F, fl.J "
          "FROM documents d JOIN fl ON d.doc_id = fl.doc_id")
def q_src_type_csv(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text")
    codes = type_codes(load(spark, sf, "labels"))
    out = docs.join(codes, "doc_id").select("type", F.col("text").alias("posts"), F.lit(".").alias("x"),
                                            F.col("doc_id").cast("string").alias("id"))
    path = scratch_path(spark, "type_csv")
    WR.write_csv(out, path)
    back = RD.read_type_corpus(spark, path)
    return back.select("user", F.md5("text").alias("digest"), *[F.col(l).cast("bigint").alias(l) for l in RD.FOUR_TRAITS])


@register("src_lexicon_tsv", D.with_ctes(bench_words=D.SQL_BENCH_WORDS, lex=D.SQL_VAD_LEX) +
          "SELECT ' say \"' || word || '\", ' AS word, valence::DOUBLE AS valence, arousal::DOUBLE AS arousal, dominance::DOUBLE AS dominance FROM lex")
def q_src_lexicon_tsv(spark, sf):
    lex = D.vad_lexicon(spark, sf).withColumn("word", F.concat(F.lit(' say "'), F.col("word"), F.lit('", '))) \
        .withColumnRenamed("word", "Word")
    path = scratch_path(spark, "lexicon_tsv")
    lex.write.options(**{**WR.CSV_WRITE, "sep": "\t"}).csv(path)
    return RD.read_lexicon(spark, path, fmt="tsv", key="Word")


@register("src_lexicon_csv", D.with_ctes(bench_words=D.SQL_BENCH_WORDS, lex=D.SQL_EMOTION_LEX) +
          "SELECT 'a \"' || word || '\"' || chr(10) || 'b' AS word, " + ", ".join(f"{e}::DOUBLE AS {e}" for e in D.EMOTIONS) + " FROM lex")
def q_src_lexicon_csv(spark, sf):
    """Emotion lexicon written as CSV (keys with quotes and line breaks, first
    column the key) and read back."""
    lex = D.emotion_lexicon(spark, sf).withColumn("word", F.concat(F.lit('a "'), F.col("word"), F.lit('"\nb')))
    path = scratch_path(spark, "lexicon_csv")
    WR.write_csv(lex, path)
    return RD.read_lexicon(spark, path)


@register("src_concept_corpus", "SELECT doc_id AS author_id, length(text)::BIGINT AS n_chars, count(DISTINCT t)::BIGINT AS n_concepts, "
          f"count(t)::BIGINT AS n_tokens FROM (SELECT doc_id, text, unnest({S.tokens('text')}) AS t FROM documents) GROUP BY doc_id, text")
def q_src_concept_corpus(spark, sf):
    """Corpus with a concept bag written and read back by its own reader."""
    docs = load(spark, sf, "documents").select("doc_id", "text")
    bags = LX.concept_bag(docs)
    path = scratch_path(spark, "concept_corpus")
    docs.join(bags, "doc_id").select(F.col("doc_id").alias("#AUTHID"), F.col("text").alias("TEXT"), "concept_count").write.parquet(path)
    back = RD.read_concept_corpus(spark, path)
    return back.select("author_id", F.length("text").cast("bigint").alias("n_chars"),
                       F.size("concept_count").cast("bigint").alias("n_concepts"),
                       F.aggregate("concept_count", F.lit(0).cast("bigint"), lambda a, x: a + x["count"]).alias("n_tokens"))


@register("src_concept_affect", D.with_ctes(bench_words=D.SQL_BENCH_WORDS, lex=D.SQL_HOURGLASS) +
          "SELECT concept, " + ", ".join(f"{a}::DOUBLE AS {a}" for a in D.AFFECT) + " FROM lex")
def q_src_concept_affect(spark, sf):
    """Concept-affect lexicon written as CSV with its descriptive columns, read
    back without them."""
    path = scratch_path(spark, "concept_affect")
    WR.write_csv(D.hourglass_lexicon(spark, sf), path)
    return RD.read_concept_affect(spark, path)


_ARFF_EXTRA = 7


def _arff_rows(spark, sf):
    lab = load(spark, sf, "labels")
    docs = load(spark, sf, "documents").select("doc_id", "n_chars")
    d = F.col("doc_id")
    j = lab.join(docs, "doc_id")
    cells = [F.col("quality").cast("string"),
             F.when(d % 7 == 0, F.lit("?")).otherwise(F.col("toxic").cast("string")),
             F.col("n_chars").cast("string")] + [(d % (k + 2)).cast("string") for k in range(_ARFF_EXTRA)]
    line = F.concat_ws(",", F.concat(F.lit("'dir\\\\id_"), d.cast("string"), F.lit("'")), *cells)
    return j.select(F.when(d % 11 == 0, F.lit("short,row")).otherwise(line).alias("value"))


@register("src_arff",
          "SELECT l.doc_id::BIGINT AS idx, l.quality::DOUBLE AS quality, CASE WHEN l.doc_id % 7 = 0 THEN NULL ELSE l.toxic::DOUBLE END AS toxic, "
          "d.n_chars::DOUBLE AS n_chars, " + ", ".join(f"(l.doc_id % {k + 2})::DOUBLE AS a{k}" for k in range(_ARFF_EXTRA))
          + " FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.doc_id % 11 <> 0")
def q_src_arff(spark, sf):
    path = scratch_path(spark, "arff")
    attrs = [("filename", "string"), ("quality", "numeric"), ("toxic", "numeric"), ("'n of chars'", "numeric")] + \
        [(f"a{k}", "numeric") for k in range(_ARFF_EXTRA)]
    # two relations with the same attributes, a quoted name, an id of its own
    rows = _arff_rows(spark, sf)
    for i in (0, 1):
        WR.write_arff(spark, rows.filter(F.pmod(F.xxhash64("value"), F.lit(2)) == i), f"{path}/r{i}", f"labels{i}", attrs)
    return RD.read_arff(spark, path).withColumnRenamed("n of chars", "n_chars")


@register("src_arff_sorted", "SELECT (row_number() OVER (ORDER BY l.doc_id) - 1)::BIGINT AS pos, l.doc_id::BIGINT AS idx FROM labels l "
          "JOIN documents d ON l.doc_id = d.doc_id WHERE l.doc_id % 11 <> 0")
def q_src_arff_sorted(spark, sf):
    """The relation sorted by id: where each id stands in the rows' own order."""
    path = scratch_path(spark, "arff_sorted")
    attrs = [("filename", "string"), ("quality", "numeric"), ("toxic", "numeric"), ("'n of chars'", "numeric")] + \
        [(f"a{k}", "numeric") for k in range(_ARFF_EXTRA)]
    WR.write_arff(spark, _arff_rows(spark, sf).repartition(5, "value"), path, "labels", attrs)
    rows = RD.read_arff(spark, path, sort=True).select("idx", F.monotonically_increasing_id().alias("_row"))
    return global_position(rows.checkpoint(), ["_row"], name="pos").select("pos", F.col("idx").cast("bigint").alias("idx"))


@register("strict_cast", D.with_ctes(bench_words=D.SQL_BENCH_WORDS, lex=D.SQL_HOURGLASS) + " UNION ALL ".join(
    f"SELECT concept, '{a}' AS affect, CAST({a} AS DOUBLE) AS value FROM lex" for a in D.AFFECT))
def q_strict_cast(spark, sf):
    """Affect values kept as text become numbers by a cast that would raise."""
    path = scratch_path(spark, "affect_text")
    D.hourglass_lexicon(spark, sf).write.parquet(path)
    lex = RD.read_concept_affect(spark, path, fmt="parquet", key="concept", drop=D.AFFECT_DESCRIPTIVE)
    return lex.unpivot(["concept"], list(D.AFFECT), "affect", "value")


_ATTR_DROP = ("drop_a", "drop_b")


@register("src_attribute_csv",
          "SELECT l.doc_id::VARCHAR AS filename, l.quality::DOUBLE AS quality, l.toxic::DOUBLE AS toxic, "
          "CASE WHEN l.doc_id % 4 = 0 THEN NULL ELSE d.n_chars::DOUBLE END AS n_chars "
          "FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def q_src_attribute_csv(spark, sf):
    """Headerless CSV + separate ``name type`` list: two names removed from the
    list (absent from the data) and the last two columns dropped by position."""
    root = scratch_path(spark, "attr_csv")
    names = ["filename string", "quality numeric", "drop_a numeric", "toxic numeric", "drop_b numeric",
             "n_chars numeric", "'Trailing one' numeric", "trailing_two numeric"]
    spark.createDataFrame([(n,) for n in names], "value string").coalesce(1).write.mode("overwrite") \
        .text(f"{root}/attrs")
    lab = load(spark, sf, "labels").join(load(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    d = F.col("doc_id")
    data = lab.select(d.cast("string"), F.col("quality").cast("string"), F.col("toxic").cast("string"),
                      F.when(d % 4 == 0, F.lit("n/a")).otherwise(F.col("n_chars").cast("string")),
                      F.lit("1"), F.lit("2"))
    WR.write_csv(data, f"{root}/data", header=False)
    return RD.read_with_attributes(spark, f"{root}/data", f"{root}/attrs", drop_attrs=_ATTR_DROP, drop_last=2)


def _vad_features(spark, sf):
    out = LX.lexicon_features(load(spark, sf, "documents"), D.vad_lexicon(spark, sf), D.VAD)
    return out.withColumnRenamed("doc_id", "author_id")


def _sql_lexicon_agg(lex_cte, scores, name="agg"):
    return {
        "bench_words": D.SQL_BENCH_WORDS, "lex": lex_cte,
        "tok": f"SELECT doc_id, unnest({S.tokens('text')}) AS word FROM documents",
        name: "SELECT d.doc_id, " + ", ".join(f"s.{x}" for x in scores) + " FROM documents d LEFT JOIN ("
              "SELECT tok.doc_id, " + ", ".join(f"sum(lex.{x})::DOUBLE / count(*) AS {x}" for x in scores)
              + " FROM tok JOIN lex ON tok.word = lex.word GROUP BY tok.doc_id) s ON d.doc_id = s.doc_id",
    }


@register("feature_sink_roundtrip", D.with_ctes(**_sql_lexicon_agg(D.SQL_VAD_LEX, D.VAD)) +
          "SELECT doc_id::VARCHAR AS author_id, " + ", ".join(f"round({x}, 6) AS {x}" for x in D.VAD) + " FROM agg")
def q_feature_sink_roundtrip(spark, sf):
    root = scratch_path(spark, "features")
    WR.write_features(_vad_features(spark, sf), root, "vad")
    back = RD.load_feature_groups(spark, root, ["vad"], multi_line=False)["vad"]  # ids are numbers
    return back.select("author_id", *[r6(x).alias(x) for x in D.VAD])


# ---- feature joins ------------------------------------------------------------------

_RD_FEATS_SQL = ("characters", "syllables", "words", "wordtypes", "sentences", "paragraphs", "long_words",
                 "complex_words", "complex_words_dc", "characters_per_word", "syll_per_word",
                 "words_per_sentence", "sentences_per_paragraph", "type_token_ratio")
_RD_FEATS = _RD_FEATS_SQL


def _sql_zscore_ctes(src: str, stats: str, out: str, key: str, cols) -> dict:
    """CTEs z-scoring ``cols`` of ``src`` over the whole table (population std;
    missing values left out, then 0; a constant column 0)."""
    st = "SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in cols) + f" FROM {src}"
    z = ", ".join(f"CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 0.0 ELSE coalesce(({c} - m_{c}) / s_{c}, 0.0) END AS {c}"
                  for c in cols)
    return {stats: st, out: f"SELECT {key}, {z} FROM {src}, {stats}"}


def _lexicon_groups(spark, sf):
    """Emotion and VAD means of every document, from one pass over its tokens."""
    both = LX.lexicon_features_multi(load(spark, sf, "documents"), {
        "emotion": (D.emotion_lexicon(spark, sf), D.EMOTIONS), "vad": (D.vad_lexicon(spark, sf), D.VAD)})
    return both.withColumnRenamed("doc_id", "author_id")


def _groups(spark, sf, enabled):
    """The enabled feature groups as tables.  The two lexicon groups come from
    one aggregate and stay one table; readability is computed only if enabled."""
    out = {}
    words = [c for g in ("emotion", "vad") if g in enabled for c in _GROUP_COLS[g]]
    if words:
        out["words"] = _lexicon_groups(spark, sf).select("author_id", *words)
    if "readability" in enabled:
        # the readability group is stored z-scored over the corpus (missing -> 0)
        out["readability"] = FE.zscore(_readability_raw(spark, sf, load(spark, sf, "documents")), list(_RD_FEATS), "author_id")
    return out


def _readability_raw(spark, sf, docs):
    from ..functions import readability as RF
    from ..operators import readability as R
    out = R.readability(docs.select("doc_id", "text"), q_prep.easy_words(spark, sf))
    return out.select(F.col("doc_id").alias("author_id"), *[F.col(c) for c in RF.COUNT_COLUMNS],
                      "complex_words_dc", *[F.col(c) for c in RF.RATIO_COLUMNS])


def _labels_keyed(spark, sf):
    return load(spark, sf, "labels").select(F.col("doc_id").alias("author_id"), "quality", "toxic")


def _sql_groups() -> dict:
    emo = _sql_lexicon_agg(D.SQL_EMOTION_LEX, D.EMOTIONS, "emo")
    vad = _sql_lexicon_agg(D.SQL_VAD_LEX, D.VAD, "vad")
    ctes = {"bench_words": emo["bench_words"], "tok": emo["tok"], "lex_e": D.SQL_EMOTION_LEX, "lex_v": D.SQL_VAD_LEX}
    ctes["emo"] = emo["emo"].replace("JOIN lex ON", "JOIN lex_e lex ON")
    ctes["vad"] = vad["vad"].replace("JOIN lex ON", "JOIN lex_v lex ON")
    counts = S.rd_counts("text")
    ctes["easy"] = q_prep._SQL_EASY
    ctes["en"] = "SELECT doc_id, text FROM documents"
    ctes["dc"] = q_prep._SQL_DC
    ctes["rc"] = ("SELECT en.doc_id, " + ", ".join(f"{v} AS {k}" for k, v in counts.items())
                  + ", dc.complex_words_dc FROM en JOIN dc ON en.doc_id = dc.doc_id")

    def d(a, b):
        return f"(({a})::DOUBLE / nullif({b}, 0))"
    ctes["rd_raw"] = ("SELECT doc_id, characters, syllables, words, wordtypes, sentences, paragraphs, long_words, "
                  "complex_words, complex_words_dc, "
                  f"{d('characters', 'words')} AS characters_per_word, {d('syllables', 'words')} AS syll_per_word, "
                  f"{d('words', 'sentences')} AS words_per_sentence, {d('sentences', 'paragraphs')} AS sentences_per_paragraph, "
                  f"{d('wordtypes', 'words')} AS type_token_ratio FROM rc")
    ctes.update(_sql_zscore_ctes("rd_raw", "rd_st", "rd", "doc_id", _RD_FEATS_SQL))
    return ctes


_GROUP_COLS = {"emotion": D.EMOTIONS, "vad": D.VAD, "readability": _RD_FEATS}
_GROUP_CTE = {"emotion": "emo", "vad": "vad", "readability": "rd"}


def _sql_feature_join(enabled) -> str:
    ctes = _sql_groups()
    first = _GROUP_CTE[enabled[0]]
    joins = " ".join(f"JOIN {_GROUP_CTE[g]} ON {first}.doc_id = {_GROUP_CTE[g]}.doc_id" for g in enabled[1:])
    cols = [(g, c) for g in enabled for c in _GROUP_COLS[g]]
    ctes["fj"] = (f"SELECT {first}.doc_id, " + ", ".join(f"coalesce({_GROUP_CTE[g]}.{c}::DOUBLE, 0) AS {c}" for g, c in cols)
                  + f", l.quality, l.toxic FROM {first} {joins} JOIN labels l ON {first}.doc_id = l.doc_id")
    unions = " UNION ALL ".join(f"SELECT doc_id::VARCHAR AS author_id, '{c}' AS feature, round({c}, 6) AS value FROM fj"
                                for _, c in cols)
    return D.with_ctes(**ctes) + unions


def _feature_join(spark, sf, enabled):
    g = _groups(spark, sf, enabled)
    joined = FE.feature_join(g, list(g))
    lab = FE.label_join(joined, _labels_keyed(spark, sf))
    feats = [c for c in joined.columns if c != "author_id"]
    long = FE.to_long(lab, "author_id", feats)
    return long.select(F.col("author_id").cast("string").alias("author_id"), "feature", r6("value").alias("value"))


@register("feature_join", _sql_feature_join(["emotion", "vad", "readability"]))
def q_feature_join(spark, sf):
    """Emotion, VAD and readability groups joined on the author, x labels,
    missing -> 0, long form."""
    return _feature_join(spark, sf, ["emotion", "vad", "readability"])


@register("feature_join_subset", _sql_feature_join(["emotion", "readability"]))
def q_feature_join_subset(spark, sf):
    return _feature_join(spark, sf, ["emotion", "readability"])


_ATTR_COLS = ("n_chars", "odd", "third")


def _sql_feature_join_all() -> str:
    ctes = _sql_groups()
    ctes["lex_h"] = D.SQL_HOURGLASS
    ctes["bag"] = "SELECT doc_id, word AS concept, count(*) AS cnt FROM tok GROUP BY 1, 2"
    ctes["aff"] = ("SELECT d.doc_id, " + ", ".join(f"a.{x}" for x in D.AFFECT) + " FROM documents d LEFT JOIN (SELECT bag.doc_id, "
                   + ", ".join(f"sum(lex_h.{a}::DOUBLE * bag.cnt) / sum(bag.cnt) AS {a}" for a in D.AFFECT)
                   + " FROM bag JOIN lex_h ON bag.concept = lex_h.concept GROUP BY bag.doc_id) a ON d.doc_id = a.doc_id")
    ctes["attr"] = "SELECT doc_id, n_chars, doc_id % 2 AS odd, doc_id % 3 AS third FROM documents"
    parts = [("emo", D.EMOTIONS), ("vad", D.VAD), ("rd", _RD_FEATS), ("aff", D.AFFECT), ("attr", _ATTR_COLS)]
    joins = " ".join(f"JOIN {c} ON emo.doc_id = {c}.doc_id" for c, _ in parts[1:])
    ctes["fj"] = ("SELECT emo.doc_id, " + ", ".join(f"coalesce({c}.{x}::DOUBLE, 0) AS {x}" for c, xs in parts for x in xs)
                  + f" FROM emo {joins} JOIN labels l ON emo.doc_id = l.doc_id")
    return D.with_ctes(**ctes) + " UNION ALL ".join(
        f"SELECT doc_id::VARCHAR AS author_id, '{x}' AS feature, round({x}, 6) AS value FROM fj" for _, xs in parts for x in xs)


@register("feature_join_all", _sql_feature_join_all())
def q_feature_join_all(spark, sf):
    """All five groups (emotion, VAD, readability, concept affect, attributes),
    each written to the feature store bucketed by author, joined from there
    without an exchange, and then with the labels."""
    root = scratch_path(spark, "groups")
    words = _lexicon_groups(spark, sf).checkpoint()
    lex = q_text.read_affect_lexicon(D.hourglass_lexicon(spark, sf))
    docs = load(spark, sf, "documents")
    groups = {
        "emotion": words.select("author_id", *D.EMOTIONS), "vad": words.select("author_id", *D.VAD),
        **_groups(spark, sf, ["readability"]),
        "affect": LX.concept_features(q_text.doc_bags(spark, sf), lex, D.AFFECT).withColumnRenamed("doc_id", "author_id"),
        "attributes": docs.select(F.col("doc_id").alias("author_id"), "n_chars", (F.col("doc_id") % 2).alias("odd"),
                                  (F.col("doc_id") % 3).alias("third"))}
    for name, g in groups.items():
        WR.write_bucketed(g, root, name, buckets=8)
    joined = FE.feature_join(RD.open_bucketed(spark, root, list(groups)))
    lab = FE.label_join(joined, _labels_keyed(spark, sf).withColumn("author_id", F.col("author_id").cast("string")))
    long = FE.to_long(lab, "author_id", [c for c in joined.columns if c != "author_id"])
    return long.select("author_id", "feature", r6("value").alias("value"))


@register("feature_label_join", D.with_ctes(**_sql_lexicon_agg(D.SQL_VAD_LEX, D.VAD)) +
          "SELECT l.doc_id AS author_id, " + ", ".join(f"round(coalesce(a.{x}, 0), 6) AS {x}" for x in D.VAD)
          + ", l.quality::DOUBLE AS quality, l.toxic::DOUBLE AS toxic FROM agg a JOIN labels l "
          "ON TRY_CAST(('0' || a.doc_id::VARCHAR) AS BIGINT) = l.doc_id")
def q_feature_label_join(spark, sf):
    """Four-trait style: the feature key is text (``"012"``), the label key a
    number; both are compared as numbers, then missing -> 0."""
    feats = _vad_features(spark, sf).withColumn("author_id", F.concat(F.lit("0"), F.col("author_id").cast("string")))
    lab = load(spark, sf, "labels").select(F.col("doc_id").alias("user"), "quality", "toxic")
    out = FE.label_join(feats, lab, key="author_id", label_key="user", coerce_numeric=True)
    return out.select("author_id", *[r6(x).alias(x) for x in D.VAD],
                      F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))


@register("assemble_features", D.with_ctes(**_sql_groups()) +
          "SELECT emo.doc_id, unnest(range(0, 13))::BIGINT AS idx, unnest([" +
          ", ".join(f"round(coalesce(emo.{c}, 0), 6)" for c in D.EMOTIONS) + ", " +
          ", ".join(f"round(coalesce(vad.{c}, 0), 6)" for c in D.VAD) +
          "]) AS value FROM emo JOIN vad ON emo.doc_id = vad.doc_id JOIN labels l ON emo.doc_id = l.doc_id")
def q_assemble_features(spark, sf):
    joined = FE.fill_missing(_lexicon_groups(spark, sf), list(D.EMOTIONS) + list(D.VAD)).join(_labels_keyed(spark, sf), "author_id")
    vec = FE.assemble(joined, list(D.EMOTIONS) + list(D.VAD))
    return FE.vector_long(vec, "author_id").select(
        F.col("author_id").alias("doc_id"), F.col("idx").cast("bigint").alias("idx"), r6("value").alias("value"))


@register("src_posts_csv",
          "WITH r AS (SELECT user_id, ts, event_id, event_type, row_number() OVER "
          "(PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) "
          "SELECT user_id::VARCHAR AS author, string_agg(event_type, ' ||| ' ORDER BY ts, event_id) AS text, "
          "count(*)::BIGINT AS n_posts FROM r WHERE rn <= 20 GROUP BY user_id")
def q_src_posts_csv(spark, sf):
    """Post log written as CSV (author, body, created_utc in microseconds, id)
    and read back, then the 20 most recent posts per author."""
    from ..operators.posts import recent_posts
    ev = load(spark, sf, "events")
    path = scratch_path(spark, "posts_csv")
    WR.write_csv(ev.select(F.col("user_id").cast("string").alias("author"), F.col("event_type").alias("body"),
                           F.concat((F.unix_micros(F.col("ts").cast("timestamp"))).cast("string"), F.lit(".0")).alias("created_utc"),
                           F.col("event_id").alias("id")), path)
    posts = RD.read_posts(spark, path, keep=[F.col("id").cast("bigint").alias("id")])
    return recent_posts(posts, n=20, tiebreak="id")


@register("src_concept_vectors_csv", q_text.ORACLE["lexicon_concept_vectors"])
def q_src_concept_vectors_csv(spark, sf):
    """Concept-vector lexicon written as a headerless CSV, read back (column 0
    is the concept), then count-weighted mean vectors per document."""
    lex = D.concept_vector_lexicon(spark, sf)
    path = scratch_path(spark, "concept_vec_csv")
    WR.write_csv(lex.select("concept", *[F.col("vec")[i].alias(f"d{i}") for i in range(D.CONCEPT_DIMS)]),
                 path, header=False)
    out = LX.concept_vector_features(q_text.doc_bags(spark, sf), RD.read_concept_vectors(spark, path))
    return out.select("doc_id", F.col("dim").cast("bigint").alias("dim"), r6("value").alias("value"))


@register("author_order_join",
          f"WITH dl AS ({q_prep._SQL_DL}), o AS (SELECT (row_number() OVER (ORDER BY n_tokens, doc_id) - 1)::BIGINT AS ord, doc_id, quality, "
          "toxic FROM dl) SELECT o.ord, o.doc_id, o.quality, o.toxic, i::BIGINT AS dim, round(e.embedding[i + 1]::DOUBLE, 6) AS value FROM o "
          "JOIN embeddings e ON e.vec_id = o.ord, (SELECT unnest(range(0, 64)) AS i) ii")
def q_author_order_join(spark, sf):
    """Author order after the length sort written as a side file
    (``order,user``) and read back; the embedding store, whose rows are known by
    their position only, gets its authors from it, then the labels."""
    order = global_position(q_prep.doc_lengths(spark, sf).select("doc_id", "n_tokens"), ["n_tokens", "doc_id"], name="ord")
    path, root = scratch_path(spark, "author_order"), scratch_path(spark, "ordered_store")
    WR.write_csv(order.select(F.col("ord").alias("order"), F.col("doc_id").alias("user")), path)
    emb = load(spark, sf, "embeddings").select(F.col("vec_id").alias("author_id"), F.lit(0).alias("chunk_no"), F.lit(1).alias("layer"),
                                               F.col("embedding").alias("vec"))
    for c, v in zip(WR.STORE_PARTITIONS, ("emb", "given", "mean", "head")):
        emb = emb.withColumn(c, F.lit(v))
    WR.write_embedding_store(emb, root)
    side = spark.read.csv(path, header=True, schema="order bigint, user bigint").withColumnRenamed("order", "author_id")
    vecs = WR.read_embeddings(spark, root, "emb", "given", "mean", "head", layer=1, authors=side)
    named = vecs.join(side, "author_id").join(load(spark, sf, "labels"), F.col("user") == F.col("doc_id"))
    return named.select(F.col("author_id").alias("ord"), "doc_id", "quality", "toxic", F.posexplode("vec").alias("dim", "value")).select(
        "ord", "doc_id", "quality", "toxic", F.col("dim").cast("bigint").alias("dim"), r6(F.col("value").cast("double")).alias("value"))


@register("union_corpora",
          "SELECT 'a:' || d.doc_id::VARCHAR AS author_id, l.quality, l.toxic, d.n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id "
          "UNION ALL SELECT 'b:' || d.doc_id::VARCHAR, l.quality, l.toxic, d.n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def q_union_corpora(spark, sf):
    dl = load(spark, sf, "documents").select("doc_id", "n_chars").join(load(spark, sf, "labels"), "doc_id")

    def tag(p):
        return dl.select(F.concat(F.lit(p), F.col("doc_id").cast("string")).alias("author_id"), "quality", "toxic", "n_chars")
    return tag("a:").unionByName(tag("b:"))


_SQL_MOMENTS = ("WITH st AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events WHERE event_id % 3 <> 0 GROUP BY event_type) "
                "SELECT e.event_id, e.event_type, round(CASE WHEN st.s IS NULL OR st.s = 0 THEN 0 ELSE coalesce((e.value - st.m) / st.s, 0) END, 6) AS z "
                "FROM events e LEFT JOIN st USING (event_type) WHERE e.event_id % 3 = 0")


@register("zscore_stored", _SQL_MOMENTS)
def q_zscore_stored(spark, sf):
    """Moments of each event type's value stored in two parts, as the log grows;
    events that are in neither are scored with the merged moments."""
    ev = load(spark, sf, "events").select("event_id", "event_type", "value")
    types = sorted(r[0] for r in ev.select("event_type").distinct().limit(1000).collect())
    wide = ev.select("event_id", *[F.when(F.col("event_type") == t, F.col("value")).alias(t) for t in types])
    path = scratch_path(spark, "moments")
    for part in (1, 2):
        MO.store_moments(wide.filter(F.col("event_id") % 3 == part), types, path, f"p{part}")
    z = MO.zscore_with(wide.filter(F.col("event_id") % 3 == 0), types, "event_id", MO.stored_moments(spark, path))
    own = ev.filter(F.col("event_id") % 3 == 0).join(z, "event_id")
    value = F.coalesce(*[F.when(F.col("event_type") == t, F.col(f"`{t}`")) for t in types])
    return own.select("event_id", "event_type", r6(value).alias("z"))


# ---- z-score ---------------------------------------------------------------------------

def _sql_zscore_readability() -> str:
    ctes = _sql_groups()
    keep = {k: ctes[k] for k in ("easy", "dc", "rc", "rd_raw", "rd_st", "rd")}
    ctes = {"en": "SELECT doc_id, text FROM documents", **keep}
    parts = [f"SELECT doc_id, '{c}' AS feature, round({c}, 6) AS z FROM rd" for c in _RD_FEATS]
    return D.with_ctes(**ctes) + " UNION ALL ".join(parts)


@register("zscore_readability", _sql_zscore_readability())
def q_zscore_readability(spark, sf):
    """Readability counts and ratios of the documents, z-scored over them (the
    stored form of the readability feature group)."""
    docs = load(spark, sf, "documents")
    z = FE.zscore(_readability_raw(spark, sf, docs), list(_RD_FEATS), "author_id")
    return z.unpivot(["author_id"], list(_RD_FEATS), "feature", "z").select(
        F.col("author_id").alias("doc_id"), "feature", r6("z").alias("z"))


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def _sql_zscore(compat: bool) -> str:
    cols = list(EVENT_TYPES) + ["const"]
    piv = ("SELECT user_id, " + ", ".join(f"avg(CASE WHEN event_type = '{e}' THEN value END) AS {e}" for e in EVENT_TYPES)
           + ", 1.0::DOUBLE AS const FROM events GROUP BY user_id")
    st = "SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}, max(({c} IS NULL)::INT) AS n_{c}" for c in cols) + " FROM p"
    parts = []
    for c in cols:
        z = f"CASE WHEN s_{c} = 0 THEN 0.0 ELSE ({c} - m_{c}) / s_{c} END"
        if compat:
            z = f"CASE WHEN n_{c} = 1 THEN 0.0 ELSE {z} END"
        parts.append(f"SELECT user_id, '{c}' AS feature, round(coalesce({z}, 0.0), 6) AS z FROM p, st")
    return f"WITH p AS ({piv}), st AS ({st}) " + " UNION ALL ".join(parts)


def _zscore(spark, sf, compat):
    ev = load(spark, sf, "events")
    piv = ev.groupBy("user_id").pivot("event_type", list(EVENT_TYPES)).agg(F.avg("value")) \
        .withColumn("const", F.lit(1.0))
    cols = list(EVENT_TYPES) + ["const"]
    z = FE.zscore(piv, cols, "user_id", compat=compat)
    return z.unpivot(["user_id"], cols, "feature", "z").select("user_id", "feature", r6("z").alias("z"))


@register("zscore_features", _sql_zscore(False))
def q_zscore_features(spark, sf):
    """Per-user mean event value per event type (missing where a user has no
    such event) plus a constant column, z-scored over users."""
    return _zscore(spark, sf, False)


@register("zscore_compat", _sql_zscore(True))
def q_zscore_compat(spark, sf):
    """Same, with a column holding any missing value turned to 0 entirely."""
    return _zscore(spark, sf, True)
