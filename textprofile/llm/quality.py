"""Supervised subword embeddings: a text classifier over hashed vectors.

Every word and every character n-gram of it (``MIN_N`` to ``MAX_N``, with
boundary marks) is hashed to a bucket with a learned vector.  A document is the
mean of its features' vectors, a softmax over a linear layer gives the class.
Vectors and layer are learned together by stochastic gradient descent in numpy.

Fitting takes a bounded sample of the labelled rows (``MAX_ROWS`` rows and
``MAX_BYTES`` of text in the mean, chosen by a hash of the id).  Scoring covers
every whole text: as the layer is linear in the mean, each bucket comes down
to one number (what it adds to the difference of the two logits), and a
document to the mean of its features' numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, hash60, materialize, small_batches, whole

MIN_N, MAX_N, BITS, DIM = 3, 5, 17, 16
BUCKETS = 1 << BITS
EPOCHS, RATE = 4, 0.1
MAX_ROWS, MAX_BYTES = 4_000, 16_000_000

_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_START, _END = "\x02", "\x03"


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * _MIX
    return ((h ^ h >> np.uint64(29)) * _BASE >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str | None) -> np.ndarray:
    """Buckets of all words and of their character n-grams, repeats included.

    Words are runs of non-space in lower case, with a mark at either end.  Their
    code points are hashed as polynomials, all words of the text at once.  Word
    bigrams enter by one trait: each word that repeats the one before it adds
    the same feature."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    marked = _START + (_END + _START).join(words) + _END
    c = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    starts = np.flatnonzero(c == ord(_START))  # a mark inside a word only splits it
    word = np.cumsum(c == ord(_START))
    out, h = [], c
    for n in range(2, min(MAX_N, len(c)) + 1):
        h = h[:-1] * _BASE + c[n - 1:]
        if n >= MIN_N:
            out.append(_bucket(h[word[n - 1:] == word[:len(c) - n + 1]], n))
    # of whole words: sums of code points, weighted by their place in the word
    place = np.arange(len(c)) - starts[word - 1]
    weight = (place.astype(np.uint64) + np.uint64(1)) * _MIX
    whole_ = np.add.reduceat((c + np.uint64(7)) * (weight ^ weight >> np.uint64(31)), starts)
    again = np.zeros(int((whole_[1:] == whole_[:-1]).sum()), dtype=np.uint64)
    return np.concatenate([*out, _bucket(whole_, 1), _bucket(again, 2)])


class Model:
    """vectors (BUCKETS x DIM), layer (DIM x 2) and bias (2)."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        self.layer, self.bias = np.zeros((DIM, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)

    def fit(self, texts: list[str], labels: list[int], seed: int = 5, epochs: int = EPOCHS, rate: float = RATE) -> "Model":
        bags = [np.unique(f, return_counts=True) if len(f := features(t)) else None for t in texts]
        if labels:  # start from the share of each label
            share = (np.bincount(labels, minlength=2)[:2] + 1) / (len(labels) + 2)
            self.bias = np.log(share).astype(np.float32)
        rng, step, steps = np.random.default_rng(seed), 0, max(1, epochs * len(texts))
        for _ in range(epochs):
            for i in rng.permutation(len(texts)):
                lr = rate * (1 - step / steps)
                step += 1
                if bags[i] is None:
                    continue
                ids, n = bags[i]
                share = (n / n.sum()).astype(np.float32)
                mean = share @ self.vectors[ids]
                z = mean @ self.layer + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                back = self.layer @ p
                self.layer -= lr * np.outer(mean, p)
                self.bias -= lr * 0.1 * p
                # one document moves its own vectors, by their share of it
                self.vectors[ids] -= (lr * len(ids)) * np.outer(share, back)
        return self

    def folded(self) -> tuple[np.ndarray, float]:
        """Each bucket's part of the difference of the logits, and the rest."""
        return (self.vectors @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float64), float(self.bias[1] - self.bias[0])


def score_text(text: str | None, parts: np.ndarray, bias: float) -> float:
    """Probability of label 1 under a folded model."""
    f = features(text)
    z = bias + (float(parts[f].mean()) if len(f) else 0.0)
    return float(1 / (1 + np.exp(-z))) if z >= 0 else float(np.exp(z) / (1 + np.exp(z)))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                    max_rows: int, max_bytes: int) -> list[tuple[str, int]]:
    """At most about ``max_rows`` labelled texts and ``max_bytes`` of text.
    Labels of a repeated id: the largest; null ids or labels teach nothing."""
    y = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(
        F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    u = hash60(F.concat(F.lit("fit:"), F.col("_id").cast("string")))
    y = materialize(y.withColumn("_u", u), "labels")
    below = lambda part: F.col("_u") <= int(part * ((1 << 60) - 1))
    rows = min(1.0, max_rows / max(y.count(), 1))
    # about ``max_rows`` small rows, whatever the input: they go to the texts
    d = docs.select(F.col(f"`{id_col}`").alias("_doc"), whole(f"`{text_col}`").alias("_text"))
    j = d.join(F.broadcast(y.filter(below(rows))), F.col("_doc") == F.col("_id")).groupBy("_doc").agg(
        F.min("_text").alias("_text"), F.max("_y").alias("_y"), F.max("_u").alias("_u"))
    n, size = j.agg(F.count("*"), F.sum(F.octet_length("_text"))).first()
    part = rows * min(1.0, max_rows / max(n, 1), max_bytes / max(size or 0, 1))
    rows = j.filter(below(part)).select("_doc", "_text", "_y").collect()
    return [(r["_text"], r["_y"]) for r in sorted(rows, key=lambda r: (r["_doc"], r["_text"]))]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """A model of 0/1 labels.  Without labelled rows: the untaught one."""
    sample = training_sample(docs, labels, id_col, text_col, label_col, max_rows, max_bytes)
    return Model().fit([t for t, _ in sample], [y for _, y in sample])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.7) -> DataFrame:
    """One row per input row: doc_id, score (of label 1), predicted.

    Null and empty texts get the score of the bias alone.  Repeated rows get
    equal scores, null ids stay.  An empty table gives an empty result; other
    columns are ignored, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model.folded())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, bias = shared.value
        for b in small_batches(batches):
            s = [score_text(t, parts, bias) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = bounded_batches(d).mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
