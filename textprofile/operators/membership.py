"""Membership of words in a set, as a filter before a shuffle.

A Bloom filter of the set's words is built by Spark's bitmap aggregates, one row
for every 32,768 cells.  It is looked up by broadcast: its size is bounded by
``max_bits`` whatever the set holds.  Words of the set always pass; of the others
a share passes that follows from cells per word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

_PAGE = 32768
HASHES = 3
#: 64 MB of cells, the most that is ever broadcast.
MAX_BITS = 1 << 29


def filter_bits(words: int, bits_per_word: int = 12, max_bits: int = MAX_BITS) -> int:
    """A power of two of cells."""
    return min(max_bits, max(_PAGE, 1 << math.ceil(math.log2(max(1, words * bits_per_word)))))


def _cell(word: Column, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(i), word), F.lit(bits)) + 1


def word_filter(words: DataFrame, bits: int, column: str = "word") -> DataFrame:
    """(bucket, cells): the filter of a table's words, written once."""
    cells = words.select(F.explode(F.array(*[_cell(F.col(column), i, bits) for i in range(HASHES)])).alias("cell"))
    pages = cells.groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("cells"))
    return materialize(pages, "word_filter")[0]


def may_hold(df: DataFrame, word: str, pages: DataFrame, bits: int) -> DataFrame:
    """The rows of ``df`` whose word may be in the set (null words don't)."""
    out = df
    for i in range(HASHES):
        p = F.broadcast(pages.select(F.col("bucket").alias(f"_b{i}"), F.col("cells").alias(f"_c{i}")))
        out = out.withColumn(f"_x{i}", _cell(F.col(word), i, bits)).filter(F.col(word).isNotNull())
        out = out.join(p, F.bitmap_bucket_number(f"_x{i}") == F.col(f"_b{i}"))
        at = F.bitmap_bit_position(f"_x{i}")
        byte = F.conv(F.hex(F.substring(F.col(f"_c{i}"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        out = out.filter(F.getbit(byte, (at % 8).cast("int")) == 1).drop(f"_x{i}", f"_b{i}", f"_c{i}")
    return out
