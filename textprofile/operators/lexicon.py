"""Lexicon features: token counts, weighted lexicon means, concept bags, coverage.

Plan shape for every lexicon feature: count the document's words inside its row,
join the distinct ones with the lexicon (broadcast when its size is proven small, otherwise a shuffled join that
AQE can split on hot words), and aggregate per document with partial
(map-side) aggregation.  Documents without any hit survive with NULL scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import run_lengths
from ..functions.batches import word_counts
from ..functions.text import tokenize, tokenize_batches
from .joins import MAX_BROADCAST_BYTES, sized_lookup, sized_table
from .membership import filter_bits, may_hold, word_filter


def _tokens(df: DataFrame, doc_key: str, text_col: str | None, tokens_col: str | None) -> Column:
    if tokens_col:
        return F.col(tokens_col)
    return tokenize(F.col(text_col))


def token_rows(df: DataFrame, doc_key: str = "doc_id", text_col: str = "text",
               tokens_col: str | None = None, word_col: str = "word",
               keep_empty: bool = False) -> DataFrame:
    """One row per token occurrence: ``(doc_key, word)``."""
    explode = F.explode_outer if keep_empty else F.explode
    return df.select(doc_key, explode(_tokens(df, doc_key, text_col, tokens_col)).alias(word_col))


def word_rows(df: DataFrame, doc_key: str = "doc_id", text_col: str = "text", tokens_col: str | None = None) -> DataFrame:
    """``(doc_key, _k, _n)``: each row's distinct words with their numbers, counted
    over Arrow batches; a row without words keeps one row with NULL word."""
    toks = F.col(tokens_col) if tokens_col else tokenize_batches(F.col(text_col))
    return df.select(doc_key, F.inline_outer(word_counts(toks))).toDF(doc_key, "_k", "_n")


def token_counts(df: DataFrame, doc_key: str = "doc_id", text_col: str = "text",
                 tokens_col: str | None = None) -> DataFrame:
    """``(doc_key, word, cnt)``: occurrences of each whitespace token per document."""
    return (token_rows(df, doc_key, text_col, tokens_col)
            .groupBy(doc_key, "word").agg(F.count(F.lit(1)).alias("cnt")))


def lexicon_features(docs: DataFrame, lexicon: DataFrame, scores: Sequence[str],
                     key: str = "word", doc_key: str = "doc_id", text_col: str = "text",
                     tokens_col: str | None = None, presized: bool = False,
                     max_broadcast: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Weighted lexicon mean per document.

    For each score ``s``: ``sum(count * s) / sum(count)`` over the document's
    tokens found in the lexicon (case-sensitive key equality), i.e. the mean of
    ``s`` over matched token occurrences.  NULL cells add nothing to the sum but
    the token still counts.  Documents without a hit (or without tokens) get
    NULL.  Duplicate lexicon keys multiply, as an inner equi-join does.
    ``presized=True`` means the caller made the lookup table already (e.g.
    ``sized_lookup`` once before a stream starts); it is joined as it is.

    A lexicon above ``max_broadcast`` bytes is joined by a shuffle, of which only
    words that the lexicon may hold are part, once a document with their number
    (see ``lexicon_words``).
    """
    lex = lexicon.select(F.col(key).alias("_k"), *scores).withColumn("_hit", F.lit(1))
    if not presized:
        lex, small = sized_table(lex, max_broadcast)
        if not small:
            words = lexicon_words(docs.select(doc_key, _tokens(docs, doc_key, text_col, tokens_col).alias("_t")), lex, doc_key)
            hits = words.join(lex, "_k").groupBy(F.col(doc_key).alias("_doc")).agg(
                *[F.try_divide(F.sum(F.col(s) * F.col("_n")).cast("double"), F.sum("_n")).alias(s) for s in scores])
            return docs.select(doc_key).distinct().join(hits, F.col(doc_key).eqNullSafe(F.col("_doc")), "left").select(doc_key, *scores)
        lex = F.broadcast(lex)
    joined = word_rows(docs, doc_key, text_col, tokens_col).join(lex, "_k", "left")
    hits = F.sum(F.col("_hit") * F.col("_n"))
    return joined.groupBy(doc_key).agg(
        *[F.try_divide(F.sum(F.col(s) * F.col("_n")).cast("double"), hits).alias(s) for s in scores])


def lexicon_words(docs: DataFrame, lexicon: DataFrame, doc_key: str, tokens: str = "_t", key: str = "_k",
                  bits_per_word: int = 12) -> DataFrame:
    """``(doc_key, _k, _n)``: the words of each document that the lexicon may
    hold, with their numbers.  Words are counted inside their document's row and
    looked up in a Bloom filter of the lexicon: every lexicon word passes, of the
    others about one in 200 at 12 cells a word."""
    bits = filter_bits(lexicon.count(), bits_per_word)
    pages = word_filter(lexicon.select(F.col(key).alias("word")), bits)
    words = docs.select(doc_key, F.inline(run_lengths(F.col(tokens), "_k", "_n")))
    return may_hold(words, "_k", pages, bits)


def lexicon_features_multi(docs: DataFrame, lexicons: dict, doc_key: str = "doc_id",
                           text_col: str = "text", key: str = "word") -> DataFrame:
    """Several word lexicons in one pass: ``lexicons`` maps a name to
    ``(lexicon DataFrame, score columns)``.  The lexicons are merged by word
    (a full outer join of the small lexicon tables, one hit flag per lexicon),
    then one explode, one join and one aggregate give every lexicon's weighted
    means with that lexicon's own matched-token denominator - the same values
    as one ``lexicon_features`` call per lexicon."""
    merged = None
    for name, (lex, scores) in lexicons.items():
        part = lex.select(F.col(key).alias("_k"), *scores).withColumn(f"_hit_{name}", F.lit(1))
        if merged is None:
            merged = part
        else:
            merged = merged.join(part, "_k", "full_outer")
    joined = word_rows(docs, doc_key, text_col).join(sized_lookup(merged), "_k", "left")
    aggs = []
    for name, (_, scores) in lexicons.items():
        hits = F.sum(F.col(f"_hit_{name}") * F.col("_n"))
        aggs += [F.try_divide(F.sum(F.col(s) * F.col("_n")).cast("double"), hits).alias(s) for s in scores]
    return joined.groupBy(doc_key).agg(*aggs)


def concept_bag(df: DataFrame, doc_key: str = "doc_id", text_col: str = "text",
                tokens_col: str | None = None) -> DataFrame:
    """``(doc_key, concept_count array<struct<concept, count>>)`` built from the
    document's token counts; documents without tokens get an empty bag.

    A document is one row, so its tokens are counted inside that row, as the run
    lengths of its sorted tokens: no exchange of texts or tokens, no Python."""
    bag = run_lengths(_tokens(df, doc_key, text_col, tokens_col), "concept", "count")
    empty = F.array().cast("array<struct<concept:string,count:bigint>>")
    return df.select(doc_key, F.coalesce(bag, empty).alias("concept_count"))


def explode_concepts(bags: DataFrame, doc_key: str = "doc_id",
                     bag_col: str = "concept_count") -> DataFrame:
    """``(doc_key, concept, count)`` from a concept bag column."""
    return (bags.select(doc_key, F.inline(F.col(bag_col))))


def concept_features(bags: DataFrame, lexicon: DataFrame, scores: Sequence[str],
                     key: str = "concept", doc_key: str = "doc_id",
                     bag_col: str = "concept_count") -> DataFrame:
    """Count-weighted mean of concept scores per document (NULL without hits)."""
    lex = sized_lookup(lexicon.select(F.col(key).alias("concept"), *scores)
                            .withColumn("_hit", F.lit(1)))
    rows = bags.select(doc_key, F.explode_outer(F.col(bag_col)).alias("_e")).select(
        doc_key, F.col("_e.concept").alias("concept"), F.col("_e.count").alias("count"))
    joined = rows.join(lex, "concept", "left")
    weight = F.sum(F.col("count") * F.col("_hit"))
    return joined.groupBy(doc_key).agg(
        *[F.try_divide(F.sum(F.col(s) * F.col("count")).cast("double"), weight).alias(s)
          for s in scores])


def concept_vector_features(bags: DataFrame, vectors: DataFrame, key: str = "concept",
                            vec_col: str = "vec", doc_key: str = "doc_id",
                            bag_col: str = "concept_count") -> DataFrame:
    """Count-weighted mean concept vector per document, long form
    ``(doc_key, dim, value)``; a document without hits keeps one row with NULL
    ``dim``/``value``.  A NULL cell adds nothing to the sum but its count still
    divides, as in ``lexicon_features``; a dimension without any value is NULL.
    One aggregate has one sum for each dimension (their number comes from the
    lexicon), so rows are never multiplied by dimensions before it."""
    lex = sized_lookup(vectors.select(F.col(key).alias("concept"), F.col(vec_col).alias("_v")))
    dims = lex.agg(F.max(F.size("_v"))).first()[0] or 0
    rows = bags.select(doc_key, F.explode(F.col(bag_col)).alias("_e")).select(
        doc_key, F.col("_e.concept").alias("concept"), F.col("_e.count").alias("count"))
    cells = [F.try_divide(F.sum(F.get("_v", F.lit(i)) * F.col("count")).cast("double"), F.sum("count")) for i in range(dims)]
    means = rows.join(lex, "concept").groupBy(F.col(doc_key).alias("_doc")).agg(
        F.array(*cells).cast("array<double>").alias("_m"))
    out = bags.select(doc_key).join(means, F.col(doc_key) == F.col("_doc"), "left")
    return out.select(doc_key, F.posexplode_outer("_m").alias("dim", "value"))


def lexicon_coverage(docs: DataFrame, lexicon: DataFrame, key: str = "word",
                     doc_key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct words per document, how many of them the lexicon holds, and the
    ratio (NULL without words).  Uses a left-semi style membership flag (no score columns read)."""
    lex = sized_lookup(lexicon.select(F.col(key).alias("word")).distinct()
                            .withColumn("_hit", F.lit(1)))
    words = token_rows(docs, doc_key, text_col, keep_empty=True).distinct()
    joined = words.join(lex, "word", "left")
    return joined.groupBy(doc_key).agg(
        F.count("word").alias("n_words"),
        F.count("_hit").alias("n_hits"),
    ).withColumn("coverage", F.try_divide(F.col("n_hits"), F.col("n_words")))
