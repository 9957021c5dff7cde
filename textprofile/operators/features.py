"""Feature tables: group joins, label joins, coercion, z-score, assembly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import nan_to_zero


def feature_join(groups: Mapping[str, DataFrame], enabled: Sequence[str] | None = None,
                 key: str = "author_id") -> DataFrame:
    """Inner equi-join of the enabled feature groups on the author key (rows
    of authors missing from any group drop out; duplicate keys multiply).
    All joins share one key, so after the first exchange the sides stay
    co-partitioned and Catalyst/AQE choose broadcast or sort-merge per side."""
    names = list(enabled) if enabled is not None else list(groups)
    if not names:
        raise ValueError("no feature group enabled")
    return reduce(lambda a, b: a.join(b, key), [groups[n] for n in names])


def label_join(features: DataFrame, labels: DataFrame, key: str = "author_id",
               label_key: str | None = None, coerce_numeric: bool = False) -> DataFrame:
    """Features x labels (inner), then every missing value -> 0.  With
    ``coerce_numeric`` both keys are compared as numbers (``"12"`` = 12,
    non-numbers drop out)."""
    label_key = label_key or key
    if coerce_numeric:
        f = features.withColumn("_jk", F.col(key).try_cast("bigint"))
        lab = labels.withColumn("_jk", F.col(label_key).try_cast("bigint")).drop(label_key)
        out = f.join(lab, "_jk").drop(key).withColumnRenamed("_jk", key)
    else:
        out = features.join(labels.withColumnRenamed(label_key, key), key)
    return fill_missing(out, [c for c in out.columns if c != key])


def fill_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULL / NaN -> 0 in the numeric columns ``cols``."""
    numeric = {f.name for f in df.schema.fields
               if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "decimal")}
    return df.select(*[(nan_to_zero(c).alias(c) if c in numeric and c in cols else F.col(c))
                       for c in df.columns])


def to_long(df: DataFrame, key: str | Sequence[str], cols: Sequence[str] | None = None,
            name: str = "feature", value: str = "value") -> DataFrame:
    """Wide -> long ``(key, feature, value)`` with doubles."""
    keys = [key] if isinstance(key, str) else list(key)
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in keys]
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(keys, cols, name, value)


def zscore(df: DataFrame, cols: Sequence[str], key: str | Sequence[str], compat: bool = False,
           materialize: bool = True) -> DataFrame:
    """Column z-score over the whole table with the population std.

    Missing values are left out of mean/std and become 0; a constant column
    becomes 0.  ``compat=True`` turns a whole column to 0 when any value in it
    is missing (the NaN-propagating behaviour).  The statistics are one
    partially aggregated pass returning three scalars per column, inlined
    as literals - no unpartitioned window, no join."""
    keys = [key] if isinstance(key, str) else list(key)
    if materialize:
        # the input is read twice (statistics, then scores): cut the lineage
        # once on the shared checkpoint folder instead of recomputing it
        df = df.select(*keys, *cols).checkpoint()
    st = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                *[F.stddev_pop(c).alias(f"s_{c}") for c in cols],
                *[F.max(F.col(c).isNull().cast("int")).alias(f"n_{c}") for c in cols]).first()
    out = []
    for c in cols:
        m, s, has_null = st[f"m_{c}"], st[f"s_{c}"], st[f"n_{c}"]
        if m is None or s is None or s == 0 or (compat and has_null == 1):
            z = F.lit(0.0)
        else:
            z = nan_to_zero((F.col(c) - F.lit(float(m))) / F.lit(float(s)))
        out.append(z.alias(c))
    return df.select(*keys, *out)


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Missing -> 0, then one vector column (strict: invalid values raise)."""
    filled = fill_missing(df, cols)
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(filled)


def vector_long(df: DataFrame, key: str, vec: str = "features") -> DataFrame:
    """``(key, idx, value)`` rows of a vector column."""
    return df.select(key, F.posexplode(vector_to_array(F.col(vec))).alias("idx", "value"))


def assemble_inputs(kind: str, embeddings: DataFrame | None = None, psycho: DataFrame | None = None,
                    key: str = "author_id", vec: str = "vec", out: str = "features") -> DataFrame:
    """The three model inputs: ``embedding`` (vector only), ``psycho``
    (psycholinguistic columns, missing -> 0) or ``combined`` (both, joined on
    the author key).  The width is whatever the inputs hold."""
    from pyspark.ml.functions import array_to_vector
    if kind not in ("embedding", "psycho", "combined"):
        raise ValueError(f"unknown input kind {kind!r}")
    parts, cols = [], []
    if kind in ("embedding", "combined"):
        parts.append(embeddings.select(key, array_to_vector(F.col(vec)).alias("_emb")))
        cols.append("_emb")
    if kind in ("psycho", "combined"):
        pcols = [c for c in psycho.columns if c != key]
        parts.append(psycho)
        cols += pcols
    joined = reduce(lambda a, b: a.join(b, key), parts)
    return assemble(joined, cols, out).drop(*[c for c in cols if c == "_emb"])
