"""Benchmark passages inside documents, by edit distance over words.

A document holds an item if some run of its words is within ``1 - similarity``
of the item's length in word edits (0.8: one edit for every five words).

1. Seeds: k edits leave a run of at least ceil((L - k) / (k + 1)) of an item's
   L words intact, so a document that holds it shares a gram of that length
   (three words at most) with it.  Each shared gram proposes the item-sized
   window that lines up with it.  This loses nothing.
2. CGK walk: a random walk copies a word sequence into one of three times the
   length, at each step moving on or repeating the word by a random bit of
   (step, word).  Sequences that differ by few edits fall into step again, so
   edit distance becomes Hamming distance.
3. Bit sampling: each table reads ``SAMPLES`` places of a walk; a window is a
   candidate if it agrees with the item in all places of some table.  The
   number of tables follows from the target recall.
4. Candidates are confirmed by their exact edit distance.

The items are the stated query set.  They are taken in blocks of bounded size
(``BLOCK_ITEMS`` items and ``BLOCK_BYTES`` of text in the mean), each block
broadcast and run against all documents, so what is broadcast never grows.
"""

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .alignment import Pattern
from .common import bounded_batches, materialize, small_batches, whole, words_of

BLOCK_ITEMS, BLOCK_BYTES = 5_000, 4_000_000
WALKS, SAMPLES = 6, 2
#: Share of places at which the walks of sequences at the limit still agree (measured in the tests).
AGREEMENT = 0.45
#: Windows embedded at once.
_CHUNK = 8192

def max_edits(n: int, similarity: float) -> int:
    return int(n * (1 - similarity) + 1e-9)


def n_tables(recall: float, agreement: float = AGREEMENT, samples: int = SAMPLES) -> int:
    """Tables of ``samples`` places after which a pair at the limit is found
    with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agreement ** samples)))


class Index:
    """The items of one block, ready to be searched for."""

    def __init__(self, items: list[tuple[object, str]], similarity: float = 0.8, recall: float = 0.999, seed: int = 11):
        lists = [(i, words_of(t)) for i, t in items]
        self.vocab: dict[bytes, int] = {}
        self.ids, self.similarity, self.items = [], similarity, []
        for i, w in lists:
            if w:
                self.ids.append(i)
                self.items.append([self.vocab.setdefault(x, len(self.vocab)) for x in w])
        self.lengths = np.array([len(w) for w in self.items], dtype=np.int64)
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        found: dict[int, list[tuple[int, int, int]]] = {}
        for n, w in enumerate(self.items):
            k = max_edits(len(w), similarity)
            g = min(3, -(-(len(w) - k) // (k + 1)))
            for o in range(len(w) - g + 1):
                key = 0
                for x in w[o:o + g]:
                    key = key * len(self.vocab) + x
                found.setdefault(g, []).append((key, n, o))
        for g, rows in found.items():
            a = np.array(sorted(rows), dtype=np.int64)
            self.grams[g] = (a[:, 0].copy(), a[:, 1].copy(), a[:, 2].copy())
        rng = np.random.default_rng(seed)
        self.longest = int(self.lengths.max()) if self.items else 0
        # the bit of (step, word) is a multiplicative hash; odd factors by walk, mixed with the step
        self.factors = rng.integers(1, 1 << 62, WALKS, dtype=np.uint64) | np.uint64(1)
        # places are shares of the steps that a walk over the item takes (about two a word)
        self.places = rng.random((n_tables(recall), SAMPLES)) * 1.8
        self.tables = np.array_split(np.arange(len(self.places)), WALKS)
        flat = np.concatenate([np.array(w, dtype=np.int32) for w in self.items]) if self.items else np.zeros(0, np.int32)
        starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.signatures = [self.sample(flat, starts, self.lengths, v) for v in range(WALKS)] if self.items else []

    def sample(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, v: int) -> np.ndarray:
        """What walk ``v`` over each ``words[start:start + length]`` (cut at the
        array's end) shows at the places of its tables: (windows, tables,
        SAMPLES), -2 after the last word.  The walks themselves are not kept."""
        shares = self.places[self.tables[v]]
        want = (shares[None] * lengths[:, None, None]).astype(np.int64)
        out = np.full(want.shape, -2, dtype=np.int32)
        at, ends, last = starts.copy(), np.minimum(starts + lengths, len(words)), len(words) - 1
        mix = int(self.factors[v])
        for j in range(int(want.max()) + 1 if want.size else 0):
            s = np.where(at < ends, words[np.minimum(at, last)], -2)
            hit = want == j
            if hit.any():
                out[hit] = np.broadcast_to(s[:, None, None], hit.shape)[hit]
            factor = np.uint64((mix * (2 * j + 1) ^ mix >> 17) & 0xFFFFFFFFFFFFFFFF | 1)
            at += ((s + 3).astype(np.uint64) * factor >> np.uint64(61) & np.uint64(1)).astype(np.int64)
        return out

    def collide(self, words: np.ndarray, starts: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which of the item-sized windows agree with their item in some table."""
        hit = np.zeros(len(starts), dtype=bool)
        order = np.argsort(self.lengths[item], kind="stable")  # walks of like length together
        for v in range(WALKS):
            open_ = order[~hit[order]]
            for a in range(0, len(open_), _CHUNK):
                i = open_[a:a + _CHUNK]
                got = self.sample(words, starts[i], self.lengths[item[i]], v)
                hit[i] = (got == self.signatures[v][item[i]]).all(axis=2).any(axis=1)
        return hit

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, first word, end word) of the best occurrence of
        every item in every text that holds it."""
        if not self.items:
            return []
        get, gap = self.vocab.get, self.longest + 1
        parts, bounds, at = [], [], 0
        apart = np.full(gap, -1, dtype=np.int32)
        for t in texts:  # -1: a word of no item, or between texts
            w = words_of(t)
            parts += [np.fromiter((get(x, -1) for x in w), dtype=np.int32, count=len(w)), apart]
            bounds.append((at, at + len(w)))
            at += len(w) + gap
        words = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        seeds = []
        for g, (keys, items, offsets) in self.grams.items():
            n = len(words) - g + 1
            if n <= 0:
                continue
            known = words >= 0
            ok = known[:n].copy()
            for i in range(1, g):
                ok &= known[i:n + i]
            p = np.flatnonzero(ok)
            key = np.zeros(len(p), dtype=np.int64)
            for i in range(g):
                key = key * len(self.vocab) + words[p + i]
            lo = np.searchsorted(keys, key, "left")
            there = (lo < len(keys)) & (keys[np.minimum(lo, len(keys) - 1)] == key)
            p, key, lo = p[there], key[there], lo[there]
            count = np.searchsorted(keys, key, "right") - lo
            which = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64), count) + np.arange(count.sum())
            seeds.append(np.stack([items[which], np.repeat(p, count) - offsets[which], np.repeat(p, count)], axis=1))
        if not seeds or not sum(map(len, seeds)):
            return []
        s = np.concatenate(seeds)
        ends = np.array([b for _, b in bounds], dtype=np.int64)
        text = np.searchsorted(ends, s[:, 2], "right")
        first = np.array([a for a, _ in bounds], dtype=np.int64)[text]
        s = np.unique(np.stack([text, s[:, 0], np.maximum(s[:, 1], first)], axis=1), axis=0)
        s = s[self.collide(words, s[:, 2], s[:, 1])]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        patterns: dict[int, Pattern] = {}
        for t, n, start in s.tolist():
            k, (a, b) = max_edits(len(self.items[n]), self.similarity), bounds[t]
            lo, hi = max(a, start - k), min(b, start + len(self.items[n]) + k)
            p = patterns.get(n) or patterns.setdefault(n, Pattern(self.items[n]))
            near = words[lo:hi].tolist()
            if p.find(near)[0] <= k:
                edits, x, y = p.locate(near)
                found = (edits, lo - a + x, lo - a + y)
                best[t, n] = min(best.get((t, n), found), found)
        return [(t, n, *found) for (t, n), found in sorted(best.items())]


def _blocks(bench: DataFrame, id_col: str, text_col: str, **kw) -> Iterator[Index]:
    """Indexes over the distinct item texts, one block at a time."""
    b = bench.select(F.col(f"`{id_col}`").alias("item_id"), whole(F.col(f"`{text_col}`").cast("string")).alias("text"))
    b = materialize(b.groupBy("text").agg(F.min("item_id").alias("item_id")), "items")
    size = b.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    n = max(1, -(-size[0] // BLOCK_ITEMS), -(-(size[1] or 0) // BLOCK_BYTES))
    for i in range(n):
        rows = b.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == i).orderBy("item_id", "text").collect()
        yield Index([(r["item_id"], r["text"]) for r in rows], **kw)


def find_passages(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", similarity: float = 0.8,
                  recall: float = 0.999) -> DataFrame:
    """One row per document row and item that it holds: doc_id, item_id, edits
    (words), item_words, first_word, end_word (of the best occurrence).

    Items with the same text count as one, under the smallest id.  Null or
    empty texts and items without words match nothing.  Ties between
    occurrences go to the first.  Repeated rows repeat their result; a null id
    is returned as null.  Empty tables give an empty result; other columns are
    ignored, whatever their names."""
    spark, out = docs.sparkSession, None
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    id_type, item_type = dict(d.dtypes)["doc_id"], dict(bench.dtypes)[item_col]
    item_arrow = to_arrow_type(bench.schema[item_col].dataType)
    schema = (f"doc_id {id_type}, item_id {item_type}, edits bigint, item_words bigint, first_word bigint, "
              "end_word bigint")
    for index in _blocks(bench, item_col, item_text, similarity=similarity, recall=recall):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ix = shared.value
            for b in small_batches(batches, 1024):
                rows = ix.search(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                     pa.array([ix.ids[r[1]] for r in rows], item_arrow),
                     *[pa.array(c, pa.int64()) for c in (
                         [r[2] for r in rows], [len(ix.items[r[1]]) for r in rows], [r[3] for r in rows],
                         [r[4] for r in rows])]],
                    names=["doc_id", "item_id", "edits", "item_words", "first_word", "end_word"])

        part = bounded_batches(d).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def _holds(shared: Broadcast) -> Callable:
    def holds(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts), dtype=bool)
        for at in range(0, len(texts), 1024):
            for t, *_ in shared.value.search(texts.iloc[at:at + 1024].tolist()):
                out[at + t] = True
        return pd.Series(out)

    return holds


def drop_contaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text: str = "text", similarity: float = 0.8, recall: float = 0.999) -> DataFrame:
    """The rows of ``docs`` that hold no item, unchanged; only the text visits
    Python, and no row moves.  Null and empty texts hold nothing; repeated rows
    stay or go together; empty tables change nothing; columns may have any names."""
    for index in _blocks(bench, item_col, item_text, similarity=similarity, recall=recall):
        holds = F.pandas_udf(_holds(docs.sparkSession.sparkContext.broadcast(index)), "boolean")
        docs = bounded_batches(docs).filter(~holds(F.col(f"`{text_col}`").cast("string")))
    return docs
