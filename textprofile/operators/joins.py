"""Join helpers: broadcast only behind a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# A lookup side is hinted for broadcast only up to this many bytes on disk.
MAX_BROADCAST_BYTES = 32 << 20


def sized_lookup(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """A lookup side, computed once: written to the shared scratch folder and
    read back, hinted for broadcast when its files hold at most ``max_bytes``.

    Beyond that no hint is given: the planner knows the table's real size, and
    adaptive execution picks the join and splits hot keys."""
    table, small = sized_table(df, max_bytes)
    return F.broadcast(table) if small else table


def sized_table(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """The table, written once, and whether its files hold at most ``max_bytes``."""
    table, size = materialize(df, "lookup")
    return table, size <= max_bytes
