"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize as _materialize

#: A word: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and read it back:
    cuts the lineage, survives lost executors, and gives later joins a leaf
    that adaptive execution can re-plan.  Removed when the driver exits."""
    return _materialize(df, name)[0]


#: Rows of whole texts that travel to a Python worker at a time.
BATCH_ROWS = 500
_BATCH_CONF, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``; has its session send at most ``BATCH_ROWS`` rows a batch where
    Spark's default of 10,000 holds, as each row is a whole text."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        conf.set(_BATCH_CONF, str(BATCH_ROWS))
    return df


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that a worker holds few texts as
    Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


#: Cells in one of Spark's bitmaps.
BITMAP = 32768


def bitmaps_of(cells: DataFrame) -> DataFrame:
    """(bucket, bits) of the positions (from 1) in column ``cell``."""
    return cells.groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))


def with_bit(df: DataFrame, cell: Column, bitmaps: DataFrame, name: str) -> DataFrame:
    """``df`` plus a boolean ``name``: the position ``cell`` is set.  A broadcast
    look-up; the bitmaps' size is bounded by the number of cells."""
    at, bucket, bits = (free_name(df, f"_{x}_{name}") for x in ("at", "bucket", "bits"))
    b = bitmaps.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits))
    out = df.withColumn(at, cell).join(F.broadcast(b), F.bitmap_bucket_number(at) == F.col(bucket), "left")
    p = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(F.col(bits), (p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return out.withColumn(name, F.coalesce(F.getbit(byte, (p % 8).cast("int")) == 1, F.lit(False))).drop(at, bucket, bits)


def whole(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def hash60(value: Column) -> Column:
    """60 leading bits of the MD5 of a string, as a non-negative bigint that
    any SQL engine can reproduce."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("bigint")


def in_fold(key: Column, mod: int, rest: int) -> Column:
    """crc32(key as text) mod ``mod`` = ``rest`` (a null key: false)."""
    return F.coalesce(F.crc32(key.cast("string")) % mod == rest, F.lit(False))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that clashes with none of ``df`` (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, in lower case."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_KEEP).split()
