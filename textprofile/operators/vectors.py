"""Vector operators: pooling, layer mixing, chunk/window means, hashing encoder,
and the plug-in encoder slot (``mapInPandas``).

Vector means use ``Summarizer`` (JVM-side vector aggregation with partial
aggregation per group) instead of exploding every dimension into rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import counts_by_code, let, unit
from ..functions.batches import offsets_of, ragged, row_slices
from .chunk import overlap_window_count
from .joins import sized_lookup
from .rank import global_position, prefix_sum


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def mean_vectors(df: DataFrame, group: Sequence[str], vec: str, out: str = "vec",
                 weight: str | None = None) -> DataFrame:
    """Element-wise (optionally weighted) mean of an ``array<float|double>``
    column per group -> ``array<double>``."""
    v = array_to_vector(F.col(vec))
    w = F.col(weight) if weight else None
    summ = Summarizer.mean(v, w) if w is not None else Summarizer.mean(v)
    return df.groupBy(*group).agg(vector_to_array(summ).alias(out))


def weighted_sum_vectors(df: DataFrame, group: Sequence[str], vec: str, weight: str,
                         out: str = "vec") -> DataFrame:
    """``sum(w * v)`` per group (weights >= 0)."""
    v = array_to_vector(F.col(vec))
    return df.groupBy(*group).agg(vector_to_array(Summarizer.sum(v, F.col(weight))).alias(out))


def first_vector(df: DataFrame, group: Sequence[str], vec: str, order: str, out: str = "vec") -> DataFrame:
    """The vector of the first row (smallest ``order``) per group."""
    return df.groupBy(*group).agg(F.min_by(vec, order).alias(out))


def pool_vectors(df: DataFrame, group: Sequence[str], vec: str, how: str = "mean",
                 order: str | None = None, out: str = "vec") -> DataFrame:
    """Token-vector pooling: ``mean`` over all rows, or ``first`` row."""
    if how == "mean":
        return mean_vectors(df, group, vec, out)
    if how == "first":
        if order is None:
            raise ValueError("first pooling needs an order column")
        return first_vector(df, group, vec, order, out)
    raise ValueError(f"unknown pooling {how!r}")


def pool_two_level(df: DataFrame, doc: Sequence[str], sub: Sequence[str], vec: str,
                   out: str = "vec") -> DataFrame:
    """Mean of sub-document means (chunks or windows), per document."""
    subs = mean_vectors(df, list(doc) + list(sub), vec, "_sub")
    return mean_vectors(subs, doc, "_sub", out)


def window_memberships(df: DataFrame, doc: str, order: str, size: int, overlap: int) -> DataFrame:
    """Assign each row of a document (ordered by ``order``) to every
    overlapping window holding it: adds ``win`` (one row per membership, at
    most ``ceil(size / step)`` per input row; ``(doc, order)`` is unique).  Only
    the keys are ranked, never the vectors.  Positions come from a
    distributed global rank, so a huge document is not sorted in one task."""
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than the window size")
    pos = global_position(df.select(doc, order), [doc, order], name="_gp")
    bounds = pos.groupBy(doc).agg(F.min("_gp").alias("_start"), F.count(F.lit(1)).alias("_n"))
    bounds = bounds.withColumn("_nw", overlap_window_count(F.col("_n"), size, overlap))
    p = F.col("_gp") - F.col("_start")
    lo = F.greatest(F.lit(0), F.ceil((p - F.lit(size - 1)) / F.lit(step)).cast("int"))
    hi = F.least(F.floor(p / F.lit(step)).cast("int"), F.col("_nw") - 1)
    member = pos.join(sized_lookup(bounds), doc).select(doc, order, F.explode(F.sequence(lo, hi)).alias("win"))
    return df.join(member, [doc, order])


def chunk_mean_by_counts(vectors: DataFrame, counts: DataFrame, order: str, vec: str,
                         run_key: str = "doc_pos", run_len: str = "n_chunks") -> DataFrame:
    """Consume a flat, ordered list of vectors in runs of the given lengths and
    average each run -> ``(run_key, vec)``.  Run starts are a distributed
    prefix sum; each run is expanded to its positions (linear in the vector
    count) and equi-joined to the vector positions."""
    pos = global_position(vectors.select(order), [order], name="_p").join(vectors.select(order, vec), order)
    starts = prefix_sum(counts.select(run_key, run_len), [run_key], run_len, name="_s")
    members = starts.filter(F.col(run_len) > 0).select(
        run_key, F.explode(F.sequence(F.col("_s"), F.col("_s") + F.col(run_len) - 1)).alias("_p"))
    return mean_vectors(members.join(pos, "_p"), [run_key], vec)


def layer_rows(df: DataFrame, key: str, vec: str, n_layers: int, dim: int) -> DataFrame:
    """Split one stacked vector into ``n_layers`` rows of ``dim`` values:
    ``(key, layer (1-based), vec)``."""
    slices = F.array(*[F.slice(F.col(vec), i * dim + 1, dim) for i in range(n_layers)])
    return df.select(key, F.posexplode(slices).alias("_l", "vec")) \
        .select(key, (F.col("_l") + 1).alias("layer"), "vec")


def layer_select(store: DataFrame, layer: int) -> DataFrame:
    """One layer (1-based): a plain filter, pushed to the scan on a store."""
    return store.filter(F.col("layer") == layer)


def layer_mix(store: DataFrame, key: Sequence[str], weights: Sequence[float] | str = "all",
              vec: str = "vec", n_layers: int | None = None) -> DataFrame:
    """Weighted sum over layers per key: ``all`` = uniform ``1/n``; an int =
    one-hot on that layer; a list = explicit weights for layers 1..n."""
    if isinstance(weights, int):
        return layer_select(store, weights).select(*key, vec)
    if weights == "all":
        if not n_layers:
            raise ValueError("uniform mixing needs n_layers")
        weights = [1.0 / n_layers] * n_layers
    wmap = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("layer").cast("int"))
    return weighted_sum_vectors(store.withColumn("_w", wmap), key, vec, "_w", out=vec)


# ---- hashing encoder (default, array expressions) --------------------------------------

def token_hash(token: Column) -> Column:
    """Portable 32-bit token hash from md5 (same value in any SQL engine)."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint")


def _token_codes(tokens: str, dim: int) -> Column:
    """``2 * bucket + (1 if the sign is minus)`` of every token (JVM-side)."""
    def code(t):
        h = token_hash(t)
        return ((h % dim) * 2 + F.shiftright(h, 6) % 2).cast("int")
    return F.transform(tokens, code)


def _hash_vectors(codes: np.ndarray, size: int, step: int, dim: int) -> np.ndarray:
    """Mean of the unit vectors of the windows of ``size`` codes."""
    n = len(codes)
    starts = [0] if n <= size else range(0, -(-(n - size) // step) * step + 1, step)
    out = np.zeros(dim)
    for a in starts:
        w = codes[a:a + size]
        v = np.bincount(w >> 1, weights=1.0 - 2.0 * (w & 1), minlength=dim)
        norm = np.sqrt((v * v).sum())
        out += v / norm if norm else v
    return out / len(starts)


def _window_means(tokens: pa.ListArray, codes: _TokenCodes, size: int | None, step: int, dim: int) -> pa.ListArray:
    """The mean hashing vector of every row's windows; null without tokens.  The
    distinct tokens of a slice of rows are hashed once, its windows are counted
    together; null tokens take a place and count nothing."""
    at, n = offsets_of(tokens)
    out = np.zeros((len(n), dim))
    for lo, hi in row_slices(n):
        full = lo + np.flatnonzero(n[lo:hi])
        if not len(full):
            continue
        length = n[full]
        d = tokens.values.take(pa.array(ragged(at[full], length))).dictionary_encode()
        of = np.fromiter((codes[t] for t in d.dictionary.to_pylist()), np.int64, len(d.dictionary))
        i = d.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        code = of[i] if len(of) else np.zeros(len(i), np.int64)
        sign = np.where(i < 0, 0.0, 1.0 - 2.0 * (code & 1))
        first = np.cumsum(length) - length
        many = np.ones(len(full), np.int64) if size is None else np.where(length <= size, 1, -((size - length) // step) + 1)
        start = np.repeat(first, many) + ragged(np.zeros(len(full), np.int64), many) * step
        held = np.repeat(length, many) if size is None else np.minimum(size, np.repeat(first + length, many) - start)
        place = ragged(start, held)
        window = np.repeat(np.arange(len(start)), held)
        v = np.bincount(window * dim + (code[place] >> 1), weights=sign[place], minlength=len(start) * dim).reshape(-1, dim)
        norm = np.sqrt((v * v).sum(axis=1))
        v /= np.where(norm > 0, norm, 1.0)[:, None]
        out[full] = np.add.reduceat(v, np.cumsum(many) - many, axis=0) / many[:, None]
    ends = pa.array((np.arange(len(n) + 1) * dim).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(out.reshape(-1)), mask=pa.array(n == 0))


def hashing_embed_docs(docs: DataFrame, key: str, tokens: str, dim: int = 64, batches: bool = False) -> DataFrame:
    """``(key, vec)`` for documents holding a token array; NULL without tokens.
    A document is one row, so its vector is made inside that row: no exchange."""
    return hashing_window_mean(docs, key, tokens, None, 0, dim, batches)


def hashing_window_mean(docs: DataFrame, key: str, tokens: str, size: int | None, overlap: int,
                        dim: int = 64, batches: bool = False) -> DataFrame:
    """Mean over a document's overlapping windows (``size`` None: one window)
    of the windows' hashing vectors -> ``(key, vec)``, NULL without tokens.
    Codes, counts and means are array expressions of the document's own row:
    no exchange, no Python.  With ``batches`` the same is counted for the rows of
    an Arrow batch together, which takes a small part of the time on long tables:
    a distinct token is hashed once and not at every place."""
    if size is not None and overlap >= size:
        raise ValueError("overlap must be smaller than the window size")
    if batches:
        codes = _TokenCodes(dim)

        @F.arrow_udf("array<double>")
        def run(a: pa.Array) -> pa.Array:
            return _window_means(a, codes, size, 1 if size is None else size - overlap, dim)
        return docs.select(key, run(F.col(tokens)).alias("vec"))

    def mean(codes: Column) -> Column:
        n = F.size(codes)
        if size is None:
            return F.when(n > 0, unit(counts_by_code(codes, dim)))
        step = size - overlap
        many = F.when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(step)).cast("int") + 1)
        zero = F.array_repeat(F.lit(0.0), dim)
        total = F.aggregate(F.sequence(F.lit(0), many - 1), zero, lambda acc, w: F.zip_with(
            acc, unit(counts_by_code(F.slice(codes, w * step + 1, F.lit(size)), dim)), lambda a, b: a + b))
        return F.when(n > 0, F.transform(total, lambda x: x / many))

    return docs.select(key, let(_token_codes(tokens, dim), mean).alias("vec"))


# ---- plug-in encoders (Arrow batches through mapInPandas) ---------------------------------

EncoderFactory = Callable[[], Callable[[list[list[str]]], np.ndarray]]
_ENCODERS: dict[str, tuple[EncoderFactory, int, int]] = {}


def register_encoder(name: str, factory: EncoderFactory, dim: int, layers: int = 1) -> None:
    """Register an encoder: ``factory()`` is called once per task and returns a
    function mapping a batch of token lists to ``[batch, layers, dim]`` (or
    ``[batch, dim]`` with one layer)."""
    _ENCODERS[name] = (factory, dim, layers)


def encoder_layers(name: str) -> int:
    return _ENCODERS[name][2]


def embed_layers(df: DataFrame, tokens: str, encoder: str, key: str = "doc_id",
                 batch_size: int = 32) -> DataFrame:
    """``(key, layer (1-based), vec array<double>)``, one row per layer, by
    running the registered encoder over batches of ``batch_size`` rows inside
    the executors; the key keeps its type.  A row without tokens gets NULL
    vectors and is not encoded."""
    factory, dim, layers = _ENCODERS[encoder]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = factory()
        for whole in batches:
            for at in range(0, whole.num_rows, batch_size):
                b = whole.slice(at, batch_size)
                toks = b.column(1).to_pylist()
                full = [i for i, t in enumerate(toks) if t]
                got = np.asarray(fn([toks[i] for i in full]), dtype=np.float64).reshape(-1, layers, dim) if full else []
                vecs = [[None] * layers for _ in toks]
                for i, v in zip(full, got):
                    vecs[i] = list(v)
                rows = pa.array(np.repeat(np.arange(len(toks)), layers))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), pa.array(np.tile(np.arange(1, layers + 1), len(toks)), pa.int32()),
                     pa.array([v for vs in vecs for v in vs], pa.list_(pa.float64()))], names=[key, "layer", "vec"])

    d = df.select(key, tokens)
    return d.mapInArrow(run, f"`{key}` {dict(d.dtypes)[key]}, layer int, vec array<double>")


def embed(df: DataFrame, tokens: str, encoder: str, key: str = "doc_id", batch_size: int = 32,
          layer: int | None = None) -> DataFrame:
    """``(key, vec)`` of one layer (default: the last)."""
    layer = layer or encoder_layers(encoder)
    return embed_layers(df, tokens, encoder, key, batch_size).filter(F.col("layer") == layer).drop("layer")


class _TokenCodes(dict):
    """Token -> ``2 * bucket + (1 if the sign is minus)``, computed once while kept."""

    def __init__(self, dim: int, most: int = 200_000):
        super().__init__()
        self.dim, self.most = dim, most

    def __missing__(self, token: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = int.from_bytes(hashlib.md5(token.encode("utf-8")).digest()[:4], "big")
        code = self[token] = 2 * (h % self.dim) + (h >> 6) % 2
        return code


def _numpy_hashing_factory(dim: int = 64):
    codes = _TokenCodes(dim)

    def fn(batch: list[list[str]]) -> np.ndarray:
        return np.stack([_hash_vectors(np.fromiter(map(codes.__getitem__, toks), np.int64, len(toks)), len(toks), 1, dim)
                         for toks in batch])
    return fn


register_encoder("hashing64_numpy", lambda: _numpy_hashing_factory(64), 64)
