"""Counting inside a row: array expressions, no exchange and no Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once (a one-element
    ``transform``), however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def run_lengths(values: Column, value: str = "value", count: str = "count") -> Column:
    """The distinct elements of an array with their numbers, in order:
    ``array<struct<value, count bigint>>``.  The array is sorted, the places where
    a new element begins are kept, and neighbouring places differ by the number.
    Null elements don't count; a null array is null."""
    def runs(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return F.when(n > 0, let(starts, lambda at: F.transform(at, lambda x, k: F.struct(
            F.get(s, x).alias(value), (F.coalesce(F.get(at, k + 1), n) - x).cast("bigint").alias(count)))))
    found = let(F.sort_array(F.array_compact(values)), lambda s: F.coalesce(runs(s), F.transform(
        F.slice(s, 1, 0), lambda x: F.struct(x.alias(value), F.lit(0).cast("bigint").alias(count)))))
    return F.when(values.isNotNull(), found)


def counts_by_code(codes: Column, size: int) -> Column:
    """``array<double>`` of length ``size``: at place b the number of codes 2 b
    less the number of codes 2 b + 1 (plus and minus signs of bucket b)."""
    def net(m: Column) -> Column:
        def at(code: Column) -> Column:
            return F.coalesce(F.try_element_at(m, code), F.lit(0).cast("bigint"))
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda b: (at(b * 2) - at(b * 2 + 1)).cast("double"))
    return let(F.map_from_entries(run_lengths(codes)), net)


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    def scaled(x: Column) -> Column:
        return let(F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, e: a + e * e)),
                   lambda n: F.transform(x, lambda e: F.when(n > 0, e / n).otherwise(e)))
    return let(v, scaled)
