"""Column moments that are stored, merged and used for later rows.

Number, mean and sum of squared deviations of a column can be merged from any
parts, so a corpus that grows adds the moments of its new part and nothing is
read again; texts that come later are scored with the corpus' own statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import nan_to_zero


def column_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, n, mean, m2, missing) of every column, in one pass; NaN and
    null values are missing."""
    c = {f"c{i}": F.col(f"`{x}`").cast("double") for i, x in enumerate(cols)}
    c = {k: F.when(~F.isnan(v), v) for k, v in c.items()}
    aggs = [a for k in c for a in (F.count(k).alias(f"n_{k}"), F.avg(k).alias(f"mean_{k}"), F.var_pop(k).alias(f"v_{k}"))]
    one = df.select(*[v.alias(k) for k, v in c.items()]).agg(F.count("*").alias("rows"), *aggs)
    return one.select("rows", F.inline(F.array(*[F.struct(
        F.lit(x).alias("feature"), F.col(f"n_{k}").alias("n"), F.coalesce(f"mean_{k}", F.lit(0.0)).alias("mean"),
        F.coalesce(F.col(f"v_{k}") * F.col(f"n_{k}"), F.lit(0.0)).alias("m2")) for x, k in zip(cols, c)]))).select(
        "feature", "n", "mean", "m2", (F.col("rows") - F.col("n")).alias("missing"))


def merge_moments(parts: DataFrame) -> DataFrame:
    """One row a feature: squared deviations are moved from each part's mean to
    the common one, so nothing cancels.  (One row a feature and part: small.)"""
    w = Window.partitionBy("feature")
    n = F.sum("n").over(w)
    mean = F.when(n > 0, F.sum(F.col("n") * F.col("mean")).over(w) / n).otherwise(0.0)
    p = parts.withColumn("_mean", mean)
    shift = F.col("mean") - F.col("_mean")
    return p.groupBy("feature").agg(F.sum("n").alias("n"), F.max("_mean").alias("mean"),
                                    F.sum(F.col("m2") + F.col("n") * shift * shift).alias("m2"), F.sum("missing").alias("missing"))


def store_moments(df: DataFrame, cols: Sequence[str], path: str, part: str) -> None:
    """Write the moments of one part of a corpus; the same part again replaces
    itself, other parts stay."""
    column_moments(df, cols).withColumn("part", F.lit(part)).coalesce(1).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def stored_moments(spark: SparkSession, path: str) -> DataFrame:
    """The merged moments of all parts."""
    return merge_moments(spark.read.parquet(path))


def zscore_with(df: DataFrame, cols: Sequence[str], key: str | Sequence[str], moments: DataFrame, compat: bool = False) -> DataFrame:
    """``cols`` less the stored means over the stored population deviations;
    missing values, constant columns and features without moments become 0, with
    ``compat`` also every column that had a missing value."""
    keys = [key] if isinstance(key, str) else list(key)
    st = {r["feature"]: r for r in moments.filter(F.col("feature").isin(*cols)).collect()}  # one row a column
    out = []
    for c in cols:
        r = st.get(c)
        s = (r["m2"] / r["n"]) ** 0.5 if r and r["n"] else 0.0
        zero = s == 0 or (compat and r["missing"] > 0)
        z = F.lit(0.0) if zero else nan_to_zero((F.col(f"`{c}`") - F.lit(r["mean"])) / F.lit(s))
        out.append(z.alias(c))
    return df.select(*keys, *out)
