"""Feature attribution and importance ranking.

Linear models: exact attributions ``phi_j = w_j * (x_j - mean_j)`` with the
background means from one aggregate (one scalar per feature, inlined as
literals - no join).  Other models: sampled Shapley values
(Strumbelj & Kononenko 2014) by permutation walks, scored as matrices inside
Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import (LinearSVCModel, LogisticRegressionModel,
                                       MultilayerPerceptronClassificationModel)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import sized_lookup
from .models import LinearScorer, RandomFourierFeatures
from .rank import global_position


def linear_attribution(df: DataFrame, key: str, features: Sequence[str], weights: Sequence[float],
                       background: DataFrame | None = None) -> DataFrame:
    """``(key, feature, phi)`` for a linear score ``sum(w_j x_j) + b``; the
    attributions of a row sum to its score minus the mean background score."""
    bg = background if background is not None else df
    means = bg.agg(*[F.avg(c).alias(c) for c in features]).first()  # one scalar per feature
    wide = df.select(
        key, *[(F.lit(float(w)) * (F.col(c) - F.lit(means[c]))).alias(c) for c, w in zip(features, weights)])
    return wide.unpivot([key], list(features), "feature", "phi")


def importance(attributions: DataFrame, group: Sequence[str] = ("trait",), feature: str = "feature",
               phi: str = "phi") -> DataFrame:
    """Global importance per feature: ``sum(|phi|)`` over rows (for two
    classes with attributions ``+-phi`` the mean over classes is ``|phi|``)."""
    return attributions.groupBy(*group, feature).agg(F.sum(F.abs(phi)).alias("importance"))


def top_features(imp: DataFrame, k: int = 3, group: Sequence[str] = ("trait",), feature: str = "feature",
                 value: str = "importance") -> DataFrame:
    """Top-``k`` features per group by importance (ties by feature name)."""
    w = Window.partitionBy(*group).orderBy(F.col(value).desc(), F.col(feature).asc())
    return imp.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def strip_type(feature: Column | str) -> Column:
    """The name in ``name type`` (attribute lists name features that way)."""
    c = F.col(feature) if isinstance(feature, str) else feature
    return F.regexp_replace(c, r"\s+(numeric|real|integer|string|nominal)$", "")


def trait_order(imp: DataFrame, traits: Sequence[str], trait: str = "trait") -> DataFrame:
    """Adds ``trait_no``, the trait's place in ``traits``."""
    return imp.withColumn("trait_no", F.array_position(F.array(*[F.lit(t) for t in traits]), F.col(trait)).cast("bigint"))


def strongest(imp: DataFrame, k: int = 128, value: str = "importance", feature: str = "feature") -> DataFrame:
    """The ``k`` strongest features overall (a top-k, planned without a full sort)."""
    return imp.orderBy(F.col(value).desc(), F.col(feature).asc()).limit(k)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def numpy_scorer(model) -> Callable[[np.ndarray], np.ndarray]:
    """Class-1 probability of a fitted model as a numpy function of a feature
    matrix: the same number that ``models.positive_probability`` gives.  A
    pipeline's stages run one after the other: random Fourier features, then a
    logistic model, a linear SVM (the logistic function of its margin), a network
    or given coefficients.  The weights have the models' size, not the data's."""
    stages = list(model.stages) if hasattr(model, "stages") else [model]
    steps = [_feature_step(s) for s in stages[:-1]] + [_score_step(stages[-1])]

    def run(x: np.ndarray) -> np.ndarray:
        for step in steps:
            x = step(x)
        return x
    return run


def _feature_step(stage) -> Callable[[np.ndarray], np.ndarray]:
    if isinstance(stage, RandomFourierFeatures):
        w, b, scale = stage.projection()
        return lambda x: scale * np.cos(x @ w + b)
    raise ValueError(f"no attribution through a stage {type(stage).__name__}")


def _score_step(model) -> Callable[[np.ndarray], np.ndarray]:
    if isinstance(model, LinearScorer):
        w, b = np.array(model.getOrDefault(model.coefficients)), float(model.getOrDefault(model.intercept))
        return lambda x: _sigmoid(x @ w + b)
    if isinstance(model, (LogisticRegressionModel, LinearSVCModel)):
        w, b = model.coefficients.toArray(), float(model.intercept)
        return lambda x: _sigmoid(x @ w + b)
    if not isinstance(model, MultilayerPerceptronClassificationModel):
        raise ValueError(f"no attribution for a model {type(model).__name__}")
    sizes, flat, at, mats = list(model.getLayers()), model.weights.toArray(), 0, []
    for n, m in zip(sizes, sizes[1:]):
        w = flat[at:at + n * m].reshape(m, n, order="F").T  # stored column by column, one row per output
        mats.append((w, flat[at + n * m:at + n * m + m]))
        at += n * m + m

    def run(x: np.ndarray) -> np.ndarray:
        for w, b in mats[:-1]:
            x = _sigmoid(x @ w + b)
        z = x @ mats[-1][0] + mats[-1][1]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z[:, 1] / z.sum(axis=1)
    return run


def sampled_attribution(model, rows: DataFrame, background: DataFrame, key: str, vec: str,
                        n_features: int, samples: int = 16, seed: int = 0, errors: bool = False) -> DataFrame:
    """Sampled Shapley values ``(key, feature, phi)`` of the model's class-1
    probability; with ``errors`` also ``se``, the standard error of ``phi``.

    For each (row, sample) a background row z (uniform over the whole background
    table) and a feature order are drawn from hashes of (row, sample, seed).
    Going through the order, one feature after the other changes from z to x;
    the change of the score is that feature's contribution, so one walk gives
    all of them.  The walk's ``n_features + 1`` points exist only as a matrix in
    the Arrow batch, one (row, sample) at a time; ``phi`` is the mean over the
    samples, and sums to the row's score less the drawn backgrounds' mean score.

    With ``errors`` the samples are antithetic pairs: the second walk of a pair
    takes the same background row and the opposite order, so the two errors
    partly cancel; a pair's mean counts as one draw, and the error is estimated
    from the spread of the pairs (null with one pair only).

    Background rows are numbered by a distributed position and fetched by an
    equi-join on the drawn number."""
    bg = background.select(vector_to_array(vec).alias("_z"))
    bg = global_position(bg.withColumn("_h", F.xxhash64(F.col("_z").cast("string"))),
                         ["_h", F.col("_z").cast("string")], name="_b").select("_b", "_z")
    n_bg = bg.count()
    if not n_bg:
        raise ValueError("no background rows")
    draws = max(1, samples // 2) if errors else samples
    grid = rows.select(key, vector_to_array(vec).alias("_x"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_s"))
    grid = grid.withColumn("_seed", F.xxhash64(key, "_s", F.lit(seed))).withColumn(
        "_b", F.pmod(F.xxhash64(key, "_s", F.lit(seed), F.lit(1)), F.lit(n_bg)))
    score = numpy_scorer(model)

    @F.pandas_udf("array<double>")
    def walk(x: pd.Series, z: pd.Series, seeds: pd.Series) -> pd.Series:
        out = []
        for a, b, s in zip(x, z, seeds):
            order = np.random.default_rng(int(s) & 0x7FFFFFFFFFFFFFFF).permutation(n_features)
            phi = np.zeros(n_features)
            both = (order, order[::-1]) if errors else (order,)
            for o in both:
                taken = np.zeros((n_features + 1, n_features), dtype=bool)
                taken[1:, o] = np.tri(n_features, dtype=bool)
                phi[o] += np.diff(score(np.where(taken, np.asarray(a), np.asarray(b))))
            out.append(phi / len(both))
        return pd.Series(out)

    phi = grid.join(sized_lookup(bg), "_b").select(key, array_to_vector(walk("_x", "_z", "_seed")).alias("_phi"))
    if not errors:
        mean = phi.groupBy(key).agg(vector_to_array(Summarizer.mean(F.col("_phi"))).alias("_phi"))
        return mean.select(key, F.posexplode("_phi").alias("feature", "phi"))
    both = Summarizer.metrics("mean", "variance").summary(F.col("_phi"))
    stats = phi.groupBy(key).agg(both.alias("_s")).select(key, F.arrays_zip(
        vector_to_array("_s.mean").alias("phi"), vector_to_array("_s.variance").alias("v")).alias("_z"))
    out = stats.select(key, F.posexplode("_z").alias("feature", "_z")).select(key, "feature", "_z.phi", "_z.v")
    se = F.when(F.lit(draws) > 1, F.sqrt(F.col("v") / F.lit(draws)))
    return out.select(key, "feature", "phi", se.alias("se"))
