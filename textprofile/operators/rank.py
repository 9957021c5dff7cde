"""Global positions and prefix sums without a single-partition window.

``Window.orderBy(...)`` without ``partitionBy`` moves every row into one task.
Instead: range-partition on the (unique) order key, sort inside partitions,
take the position inside the partition from ``monotonically_increasing_id``
(partition id in the upper bits, row number in the lower 33), checkpoint so a
recomputed partition cannot change, and add per-partition offsets computed
from a table with one row per partition (bounded by the partition count, so it
is safe to broadcast).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ROW_BITS = 33


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def ranged(df: DataFrame, order: Sequence[str | Column], num_partitions: int | None = None,
           value: str | Column | None = None) -> DataFrame:
    """Range-partitioned, locally sorted copy with ``_pid`` and ``_local``
    (0-based position inside the partition), plus ``_w`` (the weight to sum;
    1 for positions), checkpointed on the shared folder."""
    p = _partitions(df, num_partitions)
    w = F.lit(1).cast("bigint") if value is None else (F.col(value) if isinstance(value, str) else value)
    out = (df.withColumn("_w", w.cast("bigint"))
           .repartitionByRange(p, *order).sortWithinPartitions(*order)
           .withColumn("_pid", F.spark_partition_id())
           .withColumn("_local", F.monotonically_increasing_id()
                       - F.shiftleft(F.col("_pid").cast("bigint"), _ROW_BITS)))
    return out.checkpoint(eager=True)


def _offsets(r: DataFrame) -> DataFrame:
    per_part = r.groupBy("_pid").agg(F.sum("_w").alias("_n"))
    # one row per partition: a window over this tiny table is harmless
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))


def global_position(df: DataFrame, order: Sequence[str | Column], name: str = "pos",
                    num_partitions: int | None = None) -> DataFrame:
    """Add the 0-based position of each row in the total order ``order``.

    ``order`` must be unique (append the id as the last key)."""
    r = ranged(df, order, num_partitions)
    out = r.join(F.broadcast(_offsets(r)), "_pid").withColumn(name, F.col("_off") + F.col("_local"))
    return out.drop("_pid", "_local", "_off", "_w")


def prefix_sum(df: DataFrame, order: Sequence[str | Column], value: str,
               name: str = "start", num_partitions: int | None = None) -> DataFrame:
    """Add the exclusive running sum of ``value`` in the order ``order``
    (the start offset of each row's run).  Within a partition the running sum
    is a window partitioned by ``_pid`` over already co-located rows."""
    r = ranged(df, order, num_partitions, value=value)
    w = Window.partitionBy("_pid").orderBy("_local").rowsBetween(Window.unboundedPreceding, -1)
    local = r.withColumn("_inpart", F.coalesce(F.sum("_w").over(w), F.lit(0)))
    out = local.join(F.broadcast(_offsets(r)), "_pid").withColumn(name, F.col("_off") + F.col("_inpart"))
    return out.drop("_pid", "_local", "_off", "_w", "_inpart")
