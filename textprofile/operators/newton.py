"""Cross-validated L2 logistic regression: all traits and folds in one scan.

Every (trait, fold) pair is a model of its own, fitted to the rows outside the
fold.  One pass over the data gives each model's loss, gradient and Hessian at
its present weights, so a Newton step of all models costs one scan: the scans
are as many as the slowest model needs steps, whatever the number of folds.  In
the first pass all weights are zero; a fold's training sums are then the total
less the fold's own, and only the folds' sums are computed.

A task holds one (d + 1) x (d + 1) matrix a model and Spark adds them up before
the driver sees them; the models and their number are bounded by traits, folds
and features, not by rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


class FoldModels:
    """Weights of every (trait, fold): shape (traits, folds, features + 1), the
    intercept last; ``scans``: passes over the data that they took."""

    def __init__(self, traits: Sequence[str], weights: np.ndarray, scans: int, rows: DataFrame):
        self.traits, self.weights, self.scans, self.rows = list(traits), weights, scans, rows

    def accuracies(self) -> DataFrame:
        """(trait, fold from 1, acc): share of right decisions (strictly above
        0.5) on the rows of the fold; folds without rows are left out."""
        k, w = self.weights.shape[1], self.weights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, hit = np.zeros(w.shape[:2]), np.zeros(w.shape[:2])
            for b in batches:
                x, y, fold = _arrays(b, w.shape[0])
                for t in range(len(w)):
                    yes = np.einsum("ij,ij->i", x, w[t][fold[t]]) > 0
                    n[t] += np.bincount(fold[t], minlength=k)
                    hit[t] += np.bincount(fold[t], weights=yes == (y[t] > 0.5), minlength=k)
            t, f = np.indices(n.shape)
            yield pa.RecordBatch.from_arrays([pa.array(v.reshape(-1)) for v in (t, f, n, hit)], names=["t", "f", "n", "hit"])

        sums = self.rows.mapInArrow(run, "t bigint, f bigint, n double, hit double").groupBy("t", "f").agg(
            F.sum("n").alias("n"), F.sum("hit").alias("hit")).filter("n > 0")
        trait = F.element_at(F.array(*[F.lit(t) for t in self.traits]), (F.col("t") + 1).cast("int"))
        return sums.select(trait.alias("trait"), (F.col("f") + 1).cast("int").alias("fold"), (F.col("hit") / F.col("n")).alias("acc"))

    def coefficients(self) -> DataFrame:
        """(trait, fold from 1, intercept, weights)."""
        rows = [(t, f + 1, float(w[-1]), [float(v) for v in w[:-1]])
                for t, per in zip(self.traits, self.weights) for f, w in enumerate(per)]
        return self.rows.sparkSession.createDataFrame(rows, "trait string, fold int, intercept double, weights array<double>")


def _arrays(b: pa.RecordBatch, traits: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Features with a last column of ones, labels and folds by trait."""
    n = b.num_rows
    x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))
    cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(1, 2 * traits + 1)]
    return np.column_stack([x, np.ones(n)]), cols[:traits], cols[traits:]


def _pass(rows: DataFrame, traits: int, w: np.ndarray, zero: bool) -> np.ndarray:
    """(traits, folds, 1 + d + d*d): loss, gradient and Hessian over each
    model's training rows; with ``zero`` all weights are zero."""
    k, d = w.shape[1:]
    size = 1 + d + d * d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((traits, k, size))
        for b in batches:
            if not b.num_rows:
                continue
            x, y, fold = _arrays(b, traits)
            for t in range(traits):
                for f in range(k):
                    # at weights zero the fold's own rows, to be taken from the total
                    m = fold[t] == f if zero else fold[t] != f
                    xm, ym = x[m], y[t][m]
                    z = xm @ w[t, f]
                    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                    out[t, f, 0] += (np.logaddexp(0, z) - ym * z).sum()
                    out[t, f, 1:d + 1] += xm.T @ (p - ym)
                    out[t, f, d + 1:] += (xm.T @ (xm * (p * (1 - p))[:, None])).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(traits * k)), pa.array(list(out.reshape(traits * k, size)))], names=["m", "s"])

    parts = rows.mapInArrow(run, "m bigint, s array<double>").select("m", array_to_vector("s").alias("s"))
    got = np.zeros((traits * k, size))
    for r in parts.groupBy("m").agg(vector_to_array(Summarizer.sum(F.col("s"))).alias("s")).collect():  # one row a model
        got[r["m"]] = r["s"]
    got = got.reshape(traits, k, size)
    return got.sum(axis=1, keepdims=True) - got if zero else got


def fit_folds(df: DataFrame, traits: Sequence[str], k: int, features: str = "features", fold_col: str = "fold", c: float = 1.0,
              max_scans: int = 50, tol: float = 1e-9) -> FoldModels:
    """Minimise ``0.5 |w|^2 + c * sum(log loss)`` (intercept free) for every trait
    and fold; ``df`` holds ``features`` (vector or array), one 0/1 column per
    trait and ``fold_<trait>`` or a shared ``fold_col`` (from 0).  A step that
    raises a model's loss is halved.  Rows with a null feature vector, label or
    fold teach nothing."""
    spark = df.sparkSession
    x = F.col(features) if df.schema[features].dataType.typeName() == "array" else vector_to_array(features)
    folds = [F.col(f"fold_{t}" if f"fold_{t}" in df.columns else fold_col) for t in traits]
    rows = df.select(x.cast("array<double>").alias("x"), *[F.col(f"`{t}`").cast("double").alias(f"y{i}") for i, t in enumerate(traits)],
                     *[f.cast("bigint").alias(f"f{i}") for i, f in enumerate(folds)]).dropna()
    rows = materialize(rows, "cv_rows")[0]
    first = rows.select(F.size("x").alias("d")).first()
    if first is None:
        raise ValueError("no row to train on")
    d = first["d"] + 1
    ridge = np.append(np.ones(d - 1), 0.0)
    shape = (len(traits), k)
    w, step = np.zeros((*shape, d)), np.zeros((*shape, d))
    base, best, done, scans = w.copy(), np.full(shape, np.inf), np.zeros(shape, dtype=bool), 0
    while not done.all():
        if scans == max_scans:
            raise RuntimeError(f"no convergence after {max_scans} scans; is the data separable with a tiny penalty?")
        sums = _pass(rows, len(traits), w, scans == 0)
        scans += 1
        for t, f in zip(*np.nonzero(~done)):
            s, v = sums[t, f], w[t, f]
            loss = c * s[0] + 0.5 * (ridge * v * v).sum()
            if loss > best[t, f] + 1e-12 * abs(best[t, f]):  # too far: half of the step
                step[t, f] /= 2
                w[t, f] = base[t, f] + step[t, f]
                done[t, f] = np.abs(step[t, f]).max() < tol
                continue
            best[t, f], base[t, f] = loss, v
            g, h = c * s[1:d + 1] + ridge * v, c * s[d + 1:].reshape(d, d) + np.diag(ridge)
            step[t, f] = -np.linalg.lstsq(h, g, rcond=None)[0]
            w[t, f] = v + step[t, f]
            done[t, f] = np.abs(step[t, f]).max() < tol * (1 + np.abs(v).max())
    return FoldModels(traits, w, scans, rows)
