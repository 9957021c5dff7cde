"""Whitening of vectors by shifted CholeskyQR.

Entries become integers, so that their sums S are exact.  The centred rows
A = x - S/n are never held in one place.  A pass over them adds up the Gram
matrix of the present Q = A inv(R) (d x d for every task, summed by Spark) and
factors it: G = Rk' Rk.  The next pass orthogonalises again, each row through
the triangular solves of the factors so far.  The first Gram matrix gets a
shift on its diagonal, so that its Cholesky factor exists however badly
conditioned A is; the passes go on until Q'Q is the identity to rounding.  The
composed R = Rk ... R1 has A'A = R'R without A'A ever being squared into one
ill-conditioned matrix, and the singular value decomposition of R gives the
eigenvectors and eigenvalues (squares over n) of the covariance.

The driver holds d x d matrices only; every pass reads the same written table,
so a lost executor repeats its tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SCALE, OFFSET = 1024, 100_000
#: Largest magnitude of a scaled entry: beyond it a double has no exact integer.
LIMIT = float(1 << 52)
MAX_PASSES = 6


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x array<bigint>) of the vectors without null or non-finite
    entries.  Empty vectors, entries beyond 2**52 after scaling and vectors of
    another length than most (of ties the longer) have no x and go as well."""
    v = F.transform(F.col(f"`{vec_col}`"), lambda c: c.cast("double") * SCALE)
    good = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < LIMIT), F.lit(False)))
    d = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), v.alias("v")).filter(good & (F.size("v") > 0))
    x = F.transform("v", lambda c: F.floor(c).cast("bigint") + OFFSET)
    return d.select("vec_id", x.alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column(1)
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def solve_rows(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Q with Q r = a, for an upper triangular r: column after column."""
    q = np.empty_like(a)
    for j in range(a.shape[1]):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def _summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``part`` (a flat array) over all rows: one array a task, added
    up by position."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += part(_matrix(b)).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["g"])

    parts = rows.mapInArrow(run, "g array<double>").select(F.posexplode("g").alias("i", "g"))
    out = np.zeros(size)
    for r in parts.groupBy("i").agg(F.sum("g").alias("g")).collect():  # d x d numbers
        out[r["i"]] = r["g"]
    return out


class Whitening:
    """n, sums S, eigenvectors (columns) and eigenvalues, largest first.
    ``rows`` is the written table of integer vectors."""

    def __init__(self, rows: DataFrame, n: int, sums: list[int], vectors: np.ndarray, values: np.ndarray, passes: int):
        self.rows, self.n, self.sums, self.vectors, self.values, self.passes = rows, n, sums, vectors, values, passes
        self.trace = float(values.sum())
        # of directions without variance only rounding is left
        least = values.max(initial=0.0) * max(n, 1) * len(values) * np.finfo(float).eps
        self.rank = int((values > least).sum())

    def projection(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(means, d x k matrix) that whiten integer rows."""
        return means(self.sums, self.n), self.vectors[:, :k] / np.sqrt(self.values[:k])


def means(sums: list[int], n: int) -> np.ndarray:
    return np.array([s / n for s in sums])  # of whole numbers: rounded once


def fit(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> Whitening | None:
    """The whitening of all usable vectors; None without any.  Ids don't matter;
    repeated rows count as often as they stand there."""
    rows = materialize(integer_vectors(vectors, id_col, vec_col), "vectors")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if not lengths:
        return None
    n, d = lengths["n"], lengths["d"]
    rows = rows.filter(F.size("x") == d)
    sums = rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s"))
    by = {r["i"]: int(r["s"]) for r in sums.collect()}
    s = [by[i] for i in range(d)]
    m, factors = means(s, n), []

    def gram(x: np.ndarray) -> np.ndarray:
        q = x - m
        for r in factors:
            q = solve_rows(q, r)
        return q.T @ q

    r = np.eye(d)
    for k in range(MAX_PASSES):
        g = _summed(rows, gram, d * d).reshape(d, d)
        g = (g + g.T) / 2
        if k and np.abs(g - np.eye(d)).max() < 1e-14 * d:
            break
        size = float(np.trace(g))
        if size == 0.0:  # all vectors are equal
            return Whitening(rows, n, s, np.eye(d), np.zeros(d), k + 1)
        shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps * size
        step = _cholesky(g, 0.0 if k else shift, shift)
        factors.append(step)
        r = step @ r
    _, sigma, vt = np.linalg.svd(r)
    v = vt.T
    v = v * np.where(np.take_along_axis(v, np.abs(v).argmax(axis=0)[None], axis=0) < 0, -1.0, 1.0)
    return Whitening(rows, n, s, v, sigma * sigma / n, len(factors))


def _cholesky(g: np.ndarray, shift: float, more: float) -> np.ndarray:
    """Upper factor of g + shift * I; the shift grows until there is one."""
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            shift = max(more, 10 * shift)


def identity_error(model: Whitening, k: int) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    m, p = model.projection(k)
    mean = _summed(model.rows, lambda x: ((x - m) @ p).sum(axis=0), k) / model.n

    def part(x: np.ndarray) -> np.ndarray:
        w = (x - m) @ p - mean
        return w.T @ w

    return float(np.abs(_summed(model.rows, part, k * k).reshape(k, k) / model.n - np.eye(k)).max()) if k else 0.0


def deviations(x: np.ndarray, sums: list[int], n: int) -> list[int | None]:
    """Sum over the entries of (n x - S)**2 of every row, exact; None where it
    is no 64-bit integer."""
    rough = np.abs(x.astype(float) * n - np.array(sums, dtype=float))
    top = float(rough.max(initial=0.0)) + 1
    if top * top * x.shape[1] < 2.0 ** 62 and max(map(abs, sums)) < 2 ** 62 and float(np.abs(x).max(initial=0)) * n < 2.0 ** 62:
        d = x * np.int64(n) - np.array(sums, dtype=np.int64)
        return (d * d).sum(axis=1).tolist()
    out = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in out]


SCHEMA = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(model: Whitening | None, spark, id_type: str = "bigint", components: int = 8) -> DataFrame:
    """One row for every usable vector and component: vec_id, component (from
    1, by falling eigenvalue), n, deviation, whitened, explained,
    identity_error.

    Vectors that are null, empty, hold null or non-finite entries or differ in
    length from most have no rows.  Components without variance (beyond the
    rank; all, if the vectors are equal) are not returned.  The sign of an
    eigenvector makes its largest entry positive.  Repeated rows repeat their
    result, a null id stays null, an empty table gives an empty result; other
    columns are ignored, whatever their names.  A deviation beyond 64 bits is
    null."""
    k = min(components, model.rank) if model else 0
    if not k:
        return spark.createDataFrame([], f"vec_id {id_type}, {SCHEMA}")
    m, p = model.projection(k)
    error, n, sums = identity_error(model, k), model.n, model.sums
    explained = (model.values[:k] / model.trace).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b) if b.num_rows else np.zeros((0, len(sums)), dtype=np.int64)
            w, rows = (x - m) @ p, np.repeat(np.arange(b.num_rows), k)
            dev = pa.array(deviations(x, sums, n), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(len(rows), n, dtype=np.int64)), dev.take(pa.array(rows)), pa.array(w.reshape(-1)),
                 pa.array(explained * len(x), pa.float64()), pa.array(np.full(len(rows), error))],
                names=["vec_id", *[c.split()[0] for c in SCHEMA.split(", ")]])

    return model.rows.mapInArrow(run, f"vec_id {id_type}, {SCHEMA}")
