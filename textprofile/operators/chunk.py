"""Token-level shaping: vocabulary, ids, truncation, padding, chunks, windows.

All per-document work is array arithmetic inside the row (``slice``,
``sequence``, ``posexplode``); nothing is grouped except the vocabulary count
and blocks of neighbouring documents with a bounded number of tokens, whose
distinct words are looked up once a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import batches as B
from ..functions.text import OTHER_SPACE
from ..session import materialize
from .joins import sized_lookup
from .rank import global_position

# Reserved ids of the word-level encoder.
PAD_ID, START_ID, END_ID, UNK_ID = 0, 1, 2, 3
FIRST_WORD_ID = 4
#: Tokens of a block of documents; a longer document is a block of its own.
BLOCK_TOKENS = 1_000_000


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _let(expr: Column, body) -> Column:
    """Evaluate ``expr`` once and pass it to ``body`` (a one-element
    ``transform``): an argument used several times in ``body`` is not
    recomputed per use when it is itself an expression such as a tokenizer."""
    return F.transform(F.array(expr), body)[0]


def truncate_head(tokens, length: int, markers: int = 2) -> Column:
    """First ``length - markers`` tokens."""
    return F.slice(_c(tokens), 1, length - markers)


def truncate_tail(tokens, length: int, markers: int = 2) -> Column:
    """Last ``length - markers`` tokens (whole array when shorter)."""
    k = length - markers
    return _let(_c(tokens), lambda t: F.when(F.size(t) > k, F.slice(t, -k, k)).otherwise(t))


def truncate_head_tail(tokens, head_n: int, tail_n: int) -> Column:
    """First ``head_n`` and last ``tail_n`` tokens; a document no longer than
    ``head_n + tail_n`` is kept whole (no token is repeated)."""
    return _let(_c(tokens), lambda t: F.when(F.size(t) <= head_n + tail_n, t).otherwise(
        F.concat(F.slice(t, 1, head_n), F.slice(t, -tail_n, tail_n))))


def pad_ids(ids, length: int, pad: int = PAD_ID) -> Column:
    """Right-pad an id array with ``pad`` up to ``length`` (cut when longer)."""
    return _let(_c(ids), lambda i: F.slice(
        F.concat(i, F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(i), F.lit(0)))), 1, length))


def _starts(n: Column, count: Column, step: int) -> Column:
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: k * step)) \
        .otherwise(F.array().cast("array<int>"))


def chunk_fixed(df: DataFrame, tokens: str, size: int = 512, max_chunks: int | None = None,
                keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(keep..., chunk_no, chunk)``: consecutive chunks of ``size`` tokens; with
    ``max_chunks`` at most that many (the tail beyond is cut).  Empty chunks are never
    materialised (a zero-token document yields no row)."""
    n = F.size(tokens)
    count = F.ceil(n / F.lit(size)).cast("int")
    if max_chunks is not None:
        count = F.least(count, F.lit(max_chunks))
    return df.select(*keep, tokens, F.posexplode(_starts(n, count, size)).alias("chunk_no", "_s")) \
        .select(*keep, "chunk_no", F.slice(tokens, F.col("_s") + 1, size).alias("chunk"))


def overlap_window_count(n: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` tokens whose starts advance by ``size - overlap``
    until one reaches the end: 0 for no tokens, 1 when ``n <= size``."""
    step = size - overlap
    return F.when(n <= 0, F.lit(0)).when(n <= size, F.lit(1)).otherwise(
        (F.ceil((n - F.lit(size)) / F.lit(step)) + 1).cast("int"))


def chunk_overlap(df: DataFrame, tokens: str, size: int = 512, overlap: int = 256,
                  keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(keep..., chunk_no, chunk)``: overlapping windows (closed form of the
    advance-until-the-end loop)."""
    if size - overlap <= 0:
        raise ValueError("overlap must be smaller than the window size")
    n = F.size(tokens)
    count = overlap_window_count(n, size, overlap)
    return df.select(*keep, tokens, F.posexplode(_starts(n, count, size - overlap)).alias("chunk_no", "_s")) \
        .select(*keep, "chunk_no", F.slice(tokens, F.col("_s") + 1, size).alias("chunk"))


def build_vocab(token_rows: DataFrame, word: str = "word", top_n: int | None = None,
                count: str | None = None) -> DataFrame:
    """``(word, id, cnt)``: corpus counts ranked by (count desc, word asc); ids
    start after the reserved ones.  The rank is a distributed global position,
    not a single-partition window; ``top_n`` keeps the most frequent words.
    ``count`` names a column that says for how many tokens a row stands."""
    n = F.sum(count) if count else F.count(F.lit(1))
    counts = token_rows.groupBy(F.col(word).alias("word")).agg(n.alias("cnt"))
    ranked = global_position(counts, [F.col("cnt").desc(), F.col("word").asc()], name="_r")
    if top_n is not None:
        ranked = ranked.filter(F.col("_r") < top_n)
    return ranked.select("word", (F.col("_r") + FIRST_WORD_ID).alias("id"), "cnt")


def encode_ids(df: DataFrame, tokens: str, vocab: DataFrame, length: int,
               doc_key: str = "doc_id") -> DataFrame:
    """``(doc_key, ids)``: start marker, ids of the first ``length - 2`` tokens
    (unknown -> UNK), end marker, zero padding to ``length``."""
    lists = word_id_lists(df.select(doc_key, truncate_head(tokens, length).alias("_t")), "_t", vocab, doc_key)
    return lists.select(doc_key, pad_ids("ids", length).alias("ids"))


def word_id_lists(df: DataFrame, tokens: str, vocab: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """``(doc_key, ids)``: start marker, the ids of all tokens (unknown -> UNK),
    end marker; as long as the document.  Repeated rows stay; the vocabulary holds
    a word once."""
    return block_id_lists(word_blocks(df, tokens, doc_key), vocab, doc_key)


def word_blocks(df: DataFrame, words: str, doc_key: str = "doc_id", budget: int = BLOCK_TOKENS) -> DataFrame:
    """``(doc_key, _block, _codes, _words)``, one row a document, written once.

    Neighbouring rows of at most ``budget`` tokens, or one longer row, are a block.
    ``_codes`` are a row's tokens as places in its block's distinct words (-1: a
    null token); ``_words``, these words with their numbers, is on the block's
    first row and null on the others.  ``words`` is a token array or a text, which
    is split at whitespace."""
    types = dict(df.dtypes)
    is_text = types[words] == "string"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            lists = B.split_words(b.column(1), OTHER_SPACE) if is_text else b.column(1)
            at, n = B.offsets_of(lists)
            for lo, hi in B.row_slices(n, budget):
                codes, found, number = B.word_codes(lists, at[lo:hi], n[lo:hi])
                ends = np.concatenate([[0], np.cumsum(n[lo:hi])]).astype(np.int32)
                pairs = pa.StructArray.from_arrays([found, pa.array(number)], names=["word", "n"])
                places = np.append(0, np.full(hi - lo, len(pairs))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(np.full(hi - lo, b.column(2)[lo].as_py())),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(codes)),
                     pa.ListArray.from_arrays(pa.array(places), pairs, mask=pa.array(np.arange(hi - lo) > 0))],
                    names=[doc_key, "_block", "_codes", "_words"])

    col = F.make_valid_utf8(words) if is_text else F.col(words)
    coded = df.select(doc_key, col.alias("_w"), F.monotonically_increasing_id().alias("_block")).mapInArrow(
        run, f"`{doc_key}` {types[doc_key]}, _block long, _codes array<int>, _words array<struct<word:string,n:bigint>>")
    return materialize(coded, "blocks")[0]


def block_words(blocks: DataFrame) -> DataFrame:
    """``(_block, _code, word, n)``: the distinct words of each block."""
    first = blocks.filter(F.col("_words").isNotNull())
    return first.select("_block", F.posexplode("_words").alias("_code", "_w")).select("_block", "_code", "_w.word", "_w.n")


def block_id_lists(blocks: DataFrame, vocab: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """``word_id_lists`` of ``word_blocks``: the distinct words of a block are
    joined with the vocabulary, then a block's documents meet its ids."""
    looked = block_words(blocks).join(sized_lookup(vocab.select("word", "id")), "word", "left").select(
        "_block", "_code", F.coalesce("id", F.lit(UNK_ID).cast("bigint")).alias("_id"))

    def run(docs: pa.Table, ids: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        code = ids.column("_code").to_numpy()
        known = np.full(len(code) + 1, UNK_ID, dtype=np.int64)  # the last one is for code -1
        known[code] = ids.column("_id").to_numpy()
        lists = pa.concat_arrays(docs.column("_codes").chunks)
        at, n = B.offsets_of(lists)
        starts = np.concatenate([[0], np.cumsum(n + 2)])
        out = np.full(starts[-1], END_ID, dtype=np.int64)
        out[starts[:-1]] = START_ID
        out[B.ragged(starts[:-1] + 1, n)] = known[lists.values.to_numpy()[B.ragged(at, n)]]
        return pa.table([docs.column(doc_key), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(out))],
                        names=[doc_key, "ids"])

    docs = blocks.select(doc_key, F.col("_block").alias("_of"), "_codes")
    return docs.groupBy("_of").cogroup(looked.groupBy("_block")).applyInArrow(
        run, f"`{doc_key}` {dict(blocks.dtypes)[doc_key]}, ids array<bigint>")
