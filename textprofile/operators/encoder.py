"""Encoders over token ids: length-bucketed batches under a token budget.

An encoder maps a padded id matrix and its mask to hidden states, a vector for
every layer and place, which are pooled over the places that hold tokens.  Rows
that a worker gets together are put in the order of their lengths and cut into
batches whose padded size (rows times the longest) stays under the budget, so
that short texts aren't padded to long ones and no batch outgrows the memory; a
row longer than the budget is a batch of its own.  Results stand in the rows'
own order, the key keeps its type.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk import PAD_ID

#: ids, mask (both rows x places) -> hidden states (rows x layers x places x dim)
Encoder = Callable[[np.ndarray, np.ndarray], np.ndarray]
_ID_ENCODERS: dict[str, tuple[Callable[[], Encoder], int, int]] = {}
TOKEN_BUDGET = 16_384


def register_id_encoder(name: str, factory: Callable[[], Encoder], dim: int, layers: int = 1) -> None:
    """``factory()`` is called once a task and returns the encoder."""
    _ID_ENCODERS[name] = (factory, dim, layers)


def plan_batches(lengths: Sequence[int] | np.ndarray, budget: int = TOKEN_BUDGET) -> list[np.ndarray]:
    """Row numbers of each batch: rows by length (ties in their order), a batch's
    rows times its longest row under the budget.  Rows of length 0 are left out."""
    lengths = np.asarray(lengths, dtype=np.int64)
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    out, start = [], 0
    for i, row in enumerate(order):
        if i > start and (i - start + 1) * lengths[row] > budget:
            out.append(order[start:i])
            start = i
    return [*out, order[start:]] if start < len(order) else out


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of the rows, padded to the longest."""
    n = np.array([len(r) for r in rows])
    mask = np.arange(n.max()) < n[:, None]
    ids = np.full(mask.shape, PAD_ID, dtype=np.int64)
    ids[mask] = np.concatenate(rows)
    return ids, mask


def pool(hidden: np.ndarray, mask: np.ndarray, how: str) -> np.ndarray:
    """rows x layers x dim: the first place's state, or the mean over the mask."""
    if how == "first":
        return hidden[:, :, 0]
    m = mask[:, None, :, None]
    return (hidden * m).sum(axis=2) / m.sum(axis=2)


def embed_ids(df: DataFrame, ids: str, encoder: str, key: str = "doc_id", how: str = "mean", budget: int = TOKEN_BUDGET) -> DataFrame:
    """``(key, layer (1-based), vec array<double>)`` of rows with an id array;
    padding at its end is taken off first.  ``how``: ``mean`` or ``first``.  A
    null or empty list has null vectors and is not encoded; repeated rows stay."""
    if how not in ("mean", "first"):
        raise ValueError(f"unknown pooling {how!r}")
    factory, dim, layers = _ID_ENCODERS[encoder]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = factory()
        for b in batches:
            lists = b.column(1)
            rows = [np.asarray(v.values.to_numpy(zero_copy_only=False), dtype=np.int64) if v.is_valid else np.zeros(0, np.int64) for v in lists]
            ends = [np.flatnonzero(r != PAD_ID) for r in rows]
            rows = [r[:e[-1] + 1] if len(e) else r[:0] for r, e in zip(rows, ends)]
            out = np.zeros((len(rows), layers, dim))
            for at in plan_batches([len(r) for r in rows], budget):
                x, mask = padded([rows[i] for i in at])
                out[at] = pool(np.asarray(encode(x, mask), dtype=np.float64).reshape(len(at), layers, x.shape[1], dim), mask, how)
            none = np.repeat([not len(r) for r in rows], layers)
            take = pa.array(np.repeat(np.arange(len(rows)), layers))
            offsets = np.arange(0, len(none) + 1) * dim
            vec = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out.reshape(-1)), mask=pa.array(none))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), pa.array(np.tile(np.arange(1, layers + 1, dtype=np.int32), len(rows))), vec],
                names=[key, "layer", "vec"])

    d = df.select(key, F.col(ids).cast("array<bigint>").alias("_ids"))
    return d.mapInArrow(run, f"`{key}` {dict(d.dtypes)[key]}, layer int, vec array<double>")


def _demo(dim: int, layers: int) -> Encoder:
    """Hidden states from the id alone, so that SQL can say what comes out."""
    d, layer = np.arange(1, dim + 1), np.arange(1, layers + 1)

    def encode(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        x = ids[:, None, :, None] * (7 * d) + 13 * layer[:, None, None]
        return (x % 101).astype(np.float64)
    return encode


register_id_encoder("demo_ids", lambda: _demo(8, 2), 8, 2)
