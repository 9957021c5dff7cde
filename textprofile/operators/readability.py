"""Readability features per document (counts, ratios, grades, word usage)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import batches as B
from ..functions import readability as R
from ..functions.text import NON_WS, OTHER_SPACE, SENTENCE_END
from .joins import sized_lookup

# Colliding names when the groups are flattened the reference way (later
# groups overwrite earlier keys): usage pronoun/conjunction/preposition are
# replaced by the sentence-beginning counts.
_COMPAT_NAMES = {
    "use_tobeverb": "tobeverb", "use_auxverb": "auxverb", "use_nominalization": "nominalization",
    "begin_pronoun": "pronoun", "begin_interrogative": "interrogative", "begin_article": "article",
    "begin_subordination": "subordination", "begin_conjunction": "conjunction",
    "begin_preposition": "preposition",
}


def _count_batch(a: pa.Array) -> pa.StructArray:
    """``R.COUNT_COLUMNS`` of each text and its lower-case words with their
    numbers.  What depends on a word alone is found once for each distinct token
    of the batch; null texts have null counts and one paragraph."""
    n, none = len(a), a.is_null()
    st = pc.replace_substring_regex(a, SENTENCE_END, "\\1\n")
    toks = B.split_words(st, OTHER_SPACE)
    at, size = B.offsets_of(toks)
    d = toks.values.take(pa.array(B.ragged(at, size))).dictionary_encode()
    token, code = d.dictionary, d.indices.to_numpy(zero_copy_only=False)
    text = token.to_pylist()
    lower = pa.array([w.lower() for w in pc.replace_substring_regex(token, R.NON_LETTER, "").to_pylist()], pa.string())

    def numbers(x) -> np.ndarray:
        return x.to_numpy(zero_copy_only=False).astype(np.int64)
    groups = numbers(pc.count_substring_regex(lower, R.VOWEL_GROUP))
    silent = numbers(pc.ends_with(lower, "e")) * (1 - numbers(pc.ends_with(lower, "le"))) * (groups > 1)
    syllables = np.maximum(1, groups - silent)
    small = np.array([w[:1] == w[:1].lower() for w in text], dtype=bool)
    types = pa.array([w.lower() for w in text], pa.string()).dictionary_encode()
    is_word = numbers(pc.match_substring_regex(token, R.WORD_CHAR)).astype(bool)

    held = is_word[code]
    row, code = np.repeat(np.arange(n), size)[held], code[held]

    def total(of_token: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(row, weights=None if of_token is None else of_token[code], minlength=n).astype(np.int64)
    kind = np.unique(row * max(len(types.dictionary), 1) + numbers(types.indices)[code])
    blocks = pc.split_pattern_regex(st, R.PARAGRAPH_BREAK)
    b_at, b_size = B.offsets_of(blocks)
    filled = numbers(pc.match_substring_regex(blocks.values.take(pa.array(B.ragged(b_at, b_size))), NON_WS))
    out = {
        "characters": total(numbers(pc.utf8_length(token))), "syllables": total(syllables), "words": total(),
        "wordtypes": np.bincount(kind // max(len(types.dictionary), 1), minlength=n),
        # a line counts from its first character that is no space
        "sentences": numbers(pc.fill_null(pc.count_substring_regex(st, NON_WS + "[^\n]*"), 0)),
        "paragraphs": np.maximum(1, np.bincount(np.repeat(np.arange(n), b_size), weights=filled, minlength=n)).astype(np.int64),
        "long_words": total(numbers(pc.utf8_length(lower)) >= R.LONG_WORD),
        "complex_words": total((syllables >= R.COMPLEX_SYLLABLES) & small)}
    ends = np.concatenate([[0], np.cumsum(total())]).astype(np.int32)
    words = B.count_lists(pa.ListArray.from_arrays(pa.array(ends), lower.take(pa.array(code)), mask=none))
    cols = [pa.array(out[c], pa.int64(), mask=None if c == "paragraphs" else none.to_numpy(zero_copy_only=False)) for c in R.COUNT_COLUMNS]
    return pa.StructArray.from_arrays([*cols, words], names=[*R.COUNT_COLUMNS, "_words"])


def count_batches(text: Column) -> Column:
    """``_count_batch`` of a column of texts."""
    counts = ",".join(f"{c}:bigint" for c in R.COUNT_COLUMNS)

    @F.arrow_udf(f"struct<{counts},_words:array<struct<word:string,n:bigint>>>")
    def run(a: pa.Array) -> pa.Array:
        return _count_batch(a)
    return run(F.make_valid_utf8(text))


def readability(docs: DataFrame, easy_words: DataFrame, doc_key: str = "doc_id",
                text_col: str = "text", compat: bool = False) -> DataFrame:
    """All readability columns for each document (one row per input row).

    One pass: the counts of a text and of its lower-case words are made over
    Arrow batches, then the distinct words are exploded (carrying the counts)
    against the easy-word table and folded back to one row per document.  The
    aggregate is partial + final, so the shuffle carries one row per document and
    map task.  The word-usage counts are array expressions; a query that doesn't
    ask for them doesn't compute them."""
    text = F.col(text_col)
    # staged projections: each per-document / per-word regex runs once
    # (Catalyst keeps repeated non-trivial aliases in separate projections)
    counted = docs.select(doc_key, text.alias("_t"), count_batches(text).alias("_c"))
    st = counted.select(doc_key, "_c", *[v.alias(k) for k, v in R.prepare(F.col("_t")).items()])
    sp = st.select(doc_key, "_c", *[v.alias(k) for k, v in R.prepare_split(F.col("_st")).items()])
    lw = sp.select("*", *[v.alias(k) for k, v in R.prepare_words(F.col("_ws")).items()])
    c = {k: F.col(f"_c.{k}") for k in R.COUNT_COLUMNS}
    use = R.usage_from(F.col("_lw"), F.col("_sl"))
    per_doc = lw.select(doc_key, F.col("_c._words").alias("_words"), *[v.alias(k) for k, v in c.items()],
                        *[v.alias(k) for k, v in use.items()])
    easy = sized_lookup(easy_words.select(F.col("word").alias("_w1")).distinct()
                             .withColumn("_easy", F.lit(1)))
    carried = list(c) + list(use)
    exploded = per_doc.select(doc_key, *carried, F.inline_outer("_words")).withColumnRenamed("word", "_w1")
    joined = exploded.join(easy, "_w1", "left")
    base = joined.groupBy(doc_key).agg(
        *[F.first(k).alias(k) for k in carried],
        F.sum(F.when(F.col("_w1").isNotNull() & F.col("_easy").isNull(), F.col("n")).otherwise(0))
        .cast("bigint").alias("complex_words_dc"))
    cols = {k: F.col(k) for k in c}
    ratio = R.ratios(cols)
    grade = R.grades(cols, F.col("complex_words_dc"))
    out = base.select(doc_key, *[F.col(k) for k in c], "complex_words_dc",
                      *[v.alias(k) for k, v in ratio.items()],
                      *[v.alias(k) for k, v in grade.items()],
                      *[F.col(k) for k in use])
    if compat:
        out = out.drop("paragraphs", "use_pronoun", "use_conjunction", "use_preposition")
        for old, new in _COMPAT_NAMES.items():
            out = out.withColumnRenamed(old, new)
    return out
