"""Numeric column helpers: rounding, NaN handling, softmax."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def round_to(col, digits: int = 6) -> Column:
    """Round half away from zero on the scaled binary value,
    ``sign(x) * round(|x| * 10^d) / 10^d``: the same double (sign of zero
    included) as SQL engines that scale before rounding."""
    scale = float(10 ** digits)
    x = _c(col)
    return F.signum(x) * F.round(F.abs(x) * F.lit(scale), 0) / F.lit(scale)


def nan_to_zero(col) -> Column:
    """NaN and NULL -> 0.0."""
    return F.coalesce(F.nanvl(_c(col).cast("double"), F.lit(None).cast("double")), F.lit(0.0))


def softmax(arr) -> Column:
    """Softmax over an array of doubles (max-shifted for stability)."""
    a = _c(arr)
    m = F.array_max(a)
    ex = F.transform(a, lambda x: F.exp(x - m))
    total = F.aggregate(ex, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(ex, lambda x: x / total)
