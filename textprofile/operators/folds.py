"""Fold assignment and splits, all built on distributed positions.

No rank here uses a window without ``partitionBy``: positions come from
``rank.global_position`` and the per-class tables have one row per class (or
class x fold) and are broadcast only behind a size check.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rank import global_position


def seeded_order(key: str | Column, seed: int) -> Column:
    """Deterministic pseudo-random order key: ``md5(seed || ':' || key)``
    (portable to any SQL engine; ties broken by the key itself)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), k.cast("string")))


def _fold_ends(n: Column, offset: Column, k: int) -> Column:
    """Cumulative fold sizes of one class: fold ``f`` gets
    ``max(0, ceil((n - s) / k))`` rows, ``s = (f - offset) mod k``."""
    def size(f):
        return F.greatest(F.lit(0), F.ceil((n - F.pmod(f - offset, F.lit(k))) / k))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: F.aggregate(
        F.sequence(F.lit(0), f), F.lit(0).cast("bigint"), lambda acc, g: acc + size(g)))


def stratified_folds(df: DataFrame, label: str, order: str, k: int = 10, by: Sequence[str] = (),
                     fold_col: str = "fold") -> DataFrame:
    """Unshuffled stratified k-fold in row order (``order`` must be unique).

    Classes are numbered by first appearance; with the classes laid end to end
    (offset ``O`` = rows of earlier classes, ``n`` rows), fold ``f`` receives
    ``max(0, ceil((n - s) / k))`` rows of the class, ``s = (f - O) mod k``,
    handed out as contiguous runs in row order.  ``by`` runs one independent
    assignment per group (e.g. per trait).  NULL groups and classes are groups
    and classes of their own.

    Plan: one distributed position pass orders the rows by (group, class, key);
    one aggregate gives each class its size, first key and first position; a
    window over that table of classes, one group at a time, gives the offsets;
    and the table is joined back by (group, class)."""
    by = list(by)
    ranked = global_position(df, [*by, label, order], name="_p")
    names = [f"_s{i}" for i in range(len(by) + 1)]
    stats = ranked.groupBy(*[F.col(c).alias(s) for c, s in zip([*by, label], names)]).agg(
        F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n"), F.min("_p").alias("_start"))
    w = Window.partitionBy(*names[:-1]).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_o", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    # one row a (group, class): joined as it is, the planner sees its size at run time
    stats = stats.select(*names, "_start", _fold_ends(F.col("_n"), F.col("_o"), k).alias("_ends"))
    on = None
    for c, s in zip([*by, label], names):
        same = ranked[c].eqNullSafe(stats[s])
        on = same if on is None else on & same
    r = F.col("_p") - F.col("_start")
    out = ranked.join(stats, on).withColumn(fold_col, F.size(F.filter("_ends", lambda e: e <= r)))
    return out.drop(*names, "_p", "_start", "_ends")


def kfold_positions(p: Column, n: int, k: int) -> Column:
    """Fold of 0-based position ``p`` when ``n`` rows are cut into ``k``
    contiguous folds, the first ``n % k`` one row longer."""
    q, r = divmod(n, k)
    big = r * (q + 1)
    return F.when(p < big, (p / F.lit(q + 1)).cast("long")).otherwise(
        F.lit(r) + ((p - F.lit(big)) / F.lit(max(q, 1))).cast("long")).cast("int")


def kfold_shuffled(df: DataFrame, key: str, k: int = 10, seed: int = 0, fold_col: str = "fold") -> DataFrame:
    """Shuffled k-fold: rows ordered by ``seeded_order``, then contiguous folds."""
    ranked = global_position(df.withColumn("_o", seeded_order(key, seed)), ["_o", key], name="_p")
    n = ranked.count()
    return ranked.withColumn(fold_col, kfold_positions(F.col("_p"), n, k)).drop("_o", "_p")


def holdout_split(df: DataFrame, key: str, seed: int = 0, train_frac: float = 0.8,
                  val_frac: float = 0.1, split_col: str = "split") -> DataFrame:
    """Shuffle (seeded order), first ``floor(train_frac * n)`` rows train, the
    rest test; the last ``val_frac`` of the training rows form the validation
    tail."""
    ranked = global_position(df.withColumn("_o", seeded_order(key, seed)), ["_o", key], name="_p")
    n = ranked.count()
    n_train = int(n * train_frac)
    val_start = int(n_train * (1.0 - val_frac))
    p = F.col("_p")
    return ranked.withColumn(split_col, F.when(p >= n_train, "test").when(p >= val_start, "val")
                             .otherwise("train")).drop("_o", "_p")


def fold_counts(folded: DataFrame, label: str, k: int, by: Sequence[str] = (), fold_col: str = "fold") -> DataFrame:
    """Per fold: training rows (all other folds), test rows, test positives."""
    by = list(by)
    per = folded.groupBy(*by, fold_col).agg(F.count(F.lit(1)).alias("n_test"),
                                            F.sum(F.col(label).cast("bigint")).alias("pos_test"))
    if by:
        tot = folded.groupBy(*by).agg(F.count(F.lit(1)).alias("_tot"))
        joined = per.join(tot, by)  # one row a group
    else:
        joined = per.withColumn("_tot", F.lit(folded.count()))
    return joined.select(*by, fold_col, (F.col("_tot") - F.col("n_test")).alias("n_train"), "n_test", "pos_test")


def train_test(folded: DataFrame, fold: int, fold_col: str = "fold") -> tuple[DataFrame, DataFrame]:
    """Training rows (every other fold) and test rows of one fold."""
    return folded.filter(F.col(fold_col) != fold), folded.filter(F.col(fold_col) == fold)
