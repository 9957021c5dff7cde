"""Exact duplicates by two passes over Bloom cells.

Pass 1 reads the texts once and keeps (id, SHA-256) rows.  Each digest sets
``HASHES`` cells of a Bloom filter; counting the cells (map-side combined) and
keeping those that were set at least twice gives the filter of *repeated*
cells, stored as 4 KB bitmaps.  Pass 2 looks every row up in that filter by
broadcast: a row with a cell that was set once is unique for certain and goes
straight to the output, without a shuffle; only possibly repeated rows are
grouped by digest.

The filter has ``bits_per_row`` cells a row up to ``max_bits`` (128 MB, the
most that is ever broadcast).  Beyond that its false-positive rate rises, so
more rows are grouped; the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BITMAP, bitmaps_of, free_name, materialize, whole, with_bit

HASHES = 2
MAX_BITS = 1 << 30


def filter_bits(rows: int, bits_per_row: int = 16, max_bits: int = MAX_BITS) -> int:
    bits = BITMAP
    while bits < rows * bits_per_row and bits < max_bits:
        bits *= 2
    return bits


def _cells(digest: Column, bits: int) -> list[Column]:
    """Positions (from 1) of a hex digest's cells: disjoint runs of its digits."""
    return [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("bigint") % bits + 1 for i in range(HASHES)]


def repeated_cells(digests: DataFrame, bits: int) -> DataFrame:
    """(bucket, bits): the cells that at least two rows set."""
    cells = digests.select(F.explode(F.array_distinct(F.array(*_cells(F.col("text_sha256"), bits)))).alias("cell"))
    twice = cells.groupBy("cell").count().filter("count > 1")
    return bitmaps_of(twice)


def flag_possible(digests: DataFrame, bitmaps: DataFrame, bits: int) -> DataFrame:
    """``digests`` plus ``possible``: all its cells were set twice."""
    out, hit = digests, F.lit(True)
    for i, cell in enumerate(_cells(F.col("text_sha256"), bits)):
        out = with_bit(out, cell, bitmaps, f"_set{i}")
        hit = hit & F.col(f"_set{i}")
    return out.select(*digests.columns, hit.alias("possible"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16,
                     max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty, and empty texts equal
    each other.  Of equal texts the largest id stays.  Rows that agree in id
    and text are the same document and share one verdict (all marked kept, each
    counted in ``group_size``); a null id loses to any other, and stays only in
    a group that has no other.  An empty table gives an empty result.  Other
    columns are ignored, whatever their names."""
    slim = materialize(docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                                   F.sha2(whole(f"`{text_col}`"), 256).alias("text_sha256")), "digests")
    bits = filter_bits(slim.count(), bits_per_row, max_bits)
    flagged = flag_possible(slim, materialize(repeated_cells(slim, bits), "cells"), bits)
    possible = flagged.filter("possible")
    groups = materialize(possible.groupBy("text_sha256").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1"), "groups")
    grouped = possible.join(groups, "text_sha256", "left").select(
        "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), "text_sha256")
    alone = flagged.filter(~F.col("possible")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), "text_sha256")
    return alone.unionByName(grouped).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, every column kept, whatever its name.  Only
    the verdicts of dropped rows are joined back, by id and digest.  Null and
    empty texts are equal; rows alike in id and text stay or go together; an
    empty table stays empty."""
    sha, gid, gsha = (free_name(docs, n) for n in ("_sha", "_gone_id", "_gone_sha"))
    gone = exact_duplicates(docs, id_col, text_col).filter(~F.col("kept")).select(
        F.col("doc_id").alias(gid), F.col("text_sha256").alias(gsha)).distinct()
    out = docs.withColumn(sha, F.sha2(whole(f"`{text_col}`"), 256))
    return out.join(gone, (F.col(gsha) == F.col(sha)) & F.col(gid).eqNullSafe(F.col(f"`{id_col}`")),
                    "left_anti").drop(sha)


ORACLE = """
SELECT doc_id, coalesce(max(doc_id) OVER w, doc_id) AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
