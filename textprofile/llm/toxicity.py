"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are the words that mark the label in a sample of labelled texts: more
frequent by ``MIN_LIFT``, and so unlikely by chance (hypergeometric tail) that of
the terms a share of ``MAX_CHANCE`` at most is expected there by chance.  The
bound follows from the sample's own counts, so a small sample needs no more than
it can show.  Document frequencies of the terms are counted over all documents.
A text is the unit vector of (1 + log tf) * idf over these terms.

The index holds the distinct vectors of the labelled sample, each with its
numbers of examples by label, sorted so that like vectors are neighbours and
cut into blocks.  Every term keeps its postings by block and its largest weight
in each block.  A query sums these largest weights to an upper bound for every
block, visits the blocks from the highest bound down, scores their vectors
exactly, and stops at the first block whose bound is below the k-th best
similarity so far: the nearest ``k`` examples (ties with the k-th included) are
exact.

Neighbours vote with the square of their similarity, against a small prior; a
logistic curve fitted to leave-one-out votes of the sample makes the vote a
probability.  The nearest examples are returned as evidence.

The sample is bounded (``MAX_EXAMPLES`` in the mean, by a hash of the id);
equal texts count once.  Every document is scored on its whole text.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, hash60, materialize, small_batches, whole, words_of

MAX_EXAMPLES, MAX_TERMS, K, BLOCK, PRIOR = 20_000, 2_000, 25, 64, 0.5
MAX_CHANCE, MIN_LIFT = 0.05, 3.0
_CACHE = 50_000


class Space:
    """Terms with their idf weights."""

    def __init__(self, terms: list[bytes], df: list[int], n_docs: int):
        self.at = {t: i for i, t in enumerate(terms)}
        self.idf = np.log((n_docs + 1) / (np.array(df, dtype=np.float64) + 1)) + 1

    def counts(self, text: str | None) -> tuple[tuple[int, int], ...]:
        """(term, tf) pairs, by term."""
        c = Counter(map(self.at.get, words_of(text)))
        c.pop(None, None)
        return tuple(sorted(c.items()))

    def vector(self, counts: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
        t = np.array([i for i, _ in counts], dtype=np.int64)
        w = (1 + np.log(np.array([n for _, n in counts], dtype=np.float64))) * self.idf[t]
        return t, w / np.sqrt((w * w).sum()) if len(t) else w


class Index:
    """Block-max inverted index over distinct labelled vectors."""

    def __init__(self, space: Space, examples: list[tuple[int, tuple[tuple[int, int], ...], int]], k: int = K):
        self.space, self.k = space, k
        groups: dict[tuple, list[tuple[int, int]]] = {}
        for id_, counts, y in examples:
            groups.setdefault(counts, []).append((id_, y))
        plain = [y for _, y in groups.pop((), [])]  # no term at all
        ones, n = sum(plain), len(plain)
        self.plain = (ones + PRIOR * 0.1) / (n + PRIOR)
        # like vectors next to each other: by their heaviest terms first
        order = sorted(groups, key=lambda c: sorted(c, key=lambda x: -space.idf[x[0]] * (1 + np.log(x[1]))))
        self.examples = [sorted(groups[c]) for c in order]
        self.n = np.array([len(e) for e in self.examples], dtype=np.int64)
        self.ones = np.array([sum(y for _, y in e) for e in self.examples], dtype=np.int64)
        vectors = [space.vector(c) for c in order]
        self.blocks = -(-len(order) // BLOCK)
        rows = sorted((int(t), i, float(w)) for i, (ts, ws) in enumerate(vectors) for t, w in zip(ts, ws))
        self.postings: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        a = 0
        while a < len(rows):
            b = a
            while b < len(rows) and rows[b][0] == rows[a][0]:
                b += 1
            ords = np.array([r[1] for r in rows[a:b]], dtype=np.int64)
            ws = np.array([r[2] for r in rows[a:b]])
            block, start = np.unique(ords // BLOCK, return_index=True)
            self.postings[rows[a][0]] = (block, np.append(start, len(ords)), np.maximum.reduceat(ws, start), ords, ws)
            a = b
        self.curve = (1.0, 0.0)
        self.visited = 0
        self._fit_curve(order)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(entries, similarities) of the k nearest examples and all that tie
        with the k-th; ``without``: an entry of which one example is left out."""
        bound = np.zeros(self.blocks)
        lists = [(w, self.postings[t]) for t, w in zip(terms.tolist(), weights.tolist()) if t in self.postings]
        for w, (block, _, most, _, _) in lists:
            bound[block] += w * most
        size = self.n.copy() if without < 0 else self.n - (np.arange(len(self.n)) == without)
        ids, sims, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or bound[b] < least - 1e-12:
                break
            self.visited += 1
            s = np.zeros(BLOCK)
            for w, (block, start, _, ords, ws) in lists:
                i = int(np.searchsorted(block, b))
                if i < len(block) and block[i] == b:
                    p = slice(start[i], start[i + 1])
                    s[ords[p] - b * BLOCK] += w * ws[p]
            here = np.flatnonzero(s > 0)
            here = here[size[here + b * BLOCK] > 0]
            ids, sims = np.concatenate([ids, here + b * BLOCK]), np.concatenate([sims, s[here]])
            o = np.argsort(-sims, kind="stable")
            total = np.cumsum(size[ids[o]])
            if len(total) and total[-1] >= self.k:
                least = sims[o][np.searchsorted(total, self.k)]
                keep = sims >= least - 1e-12
                ids, sims = ids[keep], sims[keep]
        return ids, sims

    def vote(self, terms: np.ndarray, weights: np.ndarray, without: tuple[int, int] | None = None) -> tuple[float, list]:
        """The vote, and (entry, similarity) of the neighbours, nearest first.
        ``without``: (entry, label) of an example that doesn't vote."""
        if not len(terms):
            return self.plain, []
        ids, sims = self.nearest(terms, weights, without[0] if without else -1)
        n, ones = self.n[ids].astype(float), self.ones[ids].astype(float)
        if without:
            n -= ids == without[0]
            ones -= (ids == without[0]) * without[1]
        w = sims * sims
        v = ((w * ones).sum() + PRIOR * self.plain) / ((w * n).sum() + PRIOR)
        o = np.lexsort((ids, -np.round(sims, 12)))
        return float(v), [(int(ids[i]), float(sims[i])) for i in o]

    def _fit_curve(self, order: list) -> None:
        """A logistic curve from leave-one-out votes to labels."""
        x, y, m = [], [], []
        for e, c in enumerate(order):
            t, w = self.space.vector(c)
            for label, n in ((1, self.ones[e]), (0, self.n[e] - self.ones[e])):
                if n:
                    v, _ = self.vote(t, w, (e, label))
                    x.append(_logit(v))
                    y.append(label)
                    m.append(n)
        x, y, m = np.array(x), np.array(y, dtype=float), np.array(m, dtype=float)
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps; a pull to (1, 0) keeps it finite
            if not len(x):
                break
            p = 1 / (1 + np.exp(-(a * x + b)))
            r, h = m * (p - y), m * p * (1 - p)
            g = np.array([(r * x).sum() + (a - 1), r.sum() + b])
            hess = np.array([[(h * x * x).sum() + 1, (h * x).sum()], [(h * x).sum(), h.sum() + 1]])
            d = np.linalg.solve(hess, g)
            a, b = a - d[0], b - d[1]
            if np.abs(d).max() < 1e-9:
                break
        self.curve = (max(float(a), 0.05), float(b))

    def score(self, counts: tuple[tuple[int, int], ...], evidence: int = 3) -> tuple[float, str]:
        """(score, evidence as id:label:similarity of the nearest examples).  A
        text without any term gets the share of label 1 among such examples."""
        if not counts:
            return self.plain, ""
        v, near = self.vote(*self.space.vector(counts))
        a, b = self.curve
        p = 1 / (1 + np.exp(-(a * _logit(v) + b)))
        said = [f"{id_}:{y}:{s:.4f}" for e, s in near[:evidence] for id_, y in self.examples[e][:evidence]]
        return float(p), ",".join(said[:evidence])


def _logit(v: float) -> float:
    v = min(max(v, 1e-4), 1 - 1e-4)
    return float(np.log(v / (1 - v)))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, limit: int) -> DataFrame:
    """(doc_id, y, text): distinct labelled texts, about ``limit`` at most."""
    y = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(
        F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("y"))
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), whole(F.col(f"`{text_col}`").cast("string")).alias("text"))
    slim = d.select("doc_id", F.xxhash64("text").alias("h")).join(y, F.col("doc_id") == F.col("_id"))
    slim = materialize(slim.groupBy("h").agg(F.min("doc_id").alias("_doc"), F.max("y").alias("y"))
                       .withColumnRenamed("h", "_h"), "labelled")
    part = min(1.0, limit / max(slim.count(), 1))
    slim = slim.filter(hash60(F.concat(F.lit("knn:"), F.col("_doc").cast("string"))) <= int(part * ((1 << 60) - 1)))
    # about ``limit`` rows of three numbers, whatever the input: no text moves
    out = d.join(F.broadcast(slim), (F.col("doc_id") == F.col("_doc")) & (F.xxhash64("text") == F.col("_h")))
    return materialize(out.select("doc_id", "y", "text").dropDuplicates(["doc_id"]), "examples")


def marking_counts(words: dict[tuple[int, int], int], n1: int, n0: int) -> set[tuple[int, int]]:
    """Of the counts (texts of label 1, of label 0) with their numbers of words,
    those that mark label 1 among ``n1`` and ``n0`` texts.

    A word in n texts is in k or more of label 1 by chance with a hypergeometric
    probability.  The bound on it is the largest at which the words expected
    below it by chance, each by the steps that its own n allows, are at most
    ``MAX_CHANCE`` of the words found."""
    log = np.append(0.0, np.cumsum(np.log(np.arange(1, n1 + n0 + 1))))
    choose = lambda n, k: log[n] - log[k] - log[n - k]

    def tails(n: int) -> tuple[int, np.ndarray]:
        k = np.arange(max(0, n - n0), min(n, n1) + 1)
        at = np.exp(choose(n1, k) + choose(n0, n - k) - choose(n1 + n0, n))
        return int(k[0]), np.minimum(1.0, np.cumsum(at[::-1]))  # of k texts or more, most texts first

    totals: Counter = Counter()
    by_total: dict[int, list[tuple[int, int]]] = {}
    for (a, b), n in words.items():
        totals[a + b] += n
        if (a + 0.5) / (n1 + 1) >= MIN_LIFT * (b + 0.5) / (n0 + 1):
            by_total.setdefault(a + b, []).append((a, b))
    chance: dict[tuple[int, int], float] = {}
    for n, pairs in by_total.items():
        least, tail = tails(n)
        chance |= {(a, b): float(tail[len(tail) - 1 - (a - least)]) for a, b in pairs}
    steps = np.unique(np.array(list(chance.values())))
    expected, found = np.zeros(len(steps)), np.zeros(len(steps))
    for n, m in totals.items():
        _, tail = tails(n)
        i = np.searchsorted(tail, steps * (1 + 1e-9), side="right")
        expected += m * np.where(i > 0, tail[np.maximum(i - 1, 0)], 0.0)
    for c, x in chance.items():
        found[np.searchsorted(steps, x):] += words[c]
    good = np.flatnonzero(expected <= MAX_CHANCE * found)
    return {c for c, x in chance.items() if len(good) and x <= steps[good[-1]]}


def marking_terms(sample: DataFrame, limit: int = MAX_TERMS) -> list[bytes]:
    """Words that mark label 1 in the sample, strongest first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 512):
            by = (Counter(), Counter())
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by[1 if y else 0].update(set(words_of(t)))
            words = sorted({*by[0], *by[1]})
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([by[1][w] for w in words], pa.int64()),
                                              pa.array([by[0][w] for w in words], pa.int64())], names=["term", "n1", "n0"])

    n = sample.agg(F.count_if(F.col("y") > 0), F.count_if(F.col("y") <= 0)).first()
    c = bounded_batches(sample.select("y", "text")).mapInArrow(count, "term binary, n1 bigint, n0 bigint").groupBy("term").agg(
        F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    c = materialize(c, "words")
    pairs = {(r["n1"], r["n0"]): r["n"] for r in c.groupBy("n1", "n0").agg(F.count("*").alias("n")).collect()}
    marking = sample.sparkSession.createDataFrame(sorted(marking_counts(pairs, *n)), "n1 bigint, n0 bigint")
    r1, r0 = (F.col("n1") + 0.5) / (n[0] + 1.0), (F.col("n0") + 0.5) / (n[1] + 1.0)
    p = (F.col("n1") + F.col("n0") + 1) / (n[0] + n[1] + 2.0)
    z = (r1 - r0) / F.sqrt(p * (1 - p) * (1.0 / (n[0] + 1) + 1.0 / (n[1] + 1)))
    best = c.join(F.broadcast(marking), ["n1", "n0"]).orderBy(z.desc(), "term").limit(limit)
    return [bytes(r["term"]) for r in best.select("term").collect()]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_examples: int = MAX_EXAMPLES, k: int = K) -> Index:
    """An index of labelled examples (0/1 labels; of a repeated id or text the
    larger; null ids and labels teach nothing).  Document frequencies cover all
    rows of ``docs``.  Without labelled rows every text scores alike."""
    sample = _sample(docs, labels, id_col, text_col, label_col, max_examples)
    terms = marking_terms(sample)
    at = {t: i for i, t in enumerate(terms)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()
        for b in small_batches(batches):
            for t in b.column(0).to_pylist():
                df.update(set(map(at.get, words_of(t))))
                df[-1] += 1  # documents
        df.pop(None, None)
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.int64()), pa.array(list(df.values()), pa.int64())],
                                         names=["term", "n"])

    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    df = {r["term"]: r["n"] for r in bounded_batches(texts).mapInArrow(count, "term bigint, n bigint").groupBy("term")
          .agg(F.sum("n").alias("n")).collect()}
    space = Space(terms, [df.get(i, 0) for i in range(len(terms))], df.get(-1, 0))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            c = [space.counts(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), b.column(1).cast(pa.int64()), pa.array([[i for i, _ in x] for x in c], pa.list_(pa.int64())),
                 pa.array([[n for _, n in x] for x in c], pa.list_(pa.int64()))], names=["id", "y", "t", "n"])

    rows = bounded_batches(sample).mapInArrow(vectors, "id bigint, y bigint, t array<bigint>, n array<bigint>").collect()
    return Index(space, [(r["id"], tuple(zip(r["t"], r["n"])), int(r["y"] > 0)) for r in rows], k)


class Scorer:
    """Scores texts; remembers the results of the vectors it met."""

    def __init__(self, index: Index):
        self.index, self.known = index, {}

    def __call__(self, text: str | None) -> tuple[float, str]:
        c = self.index.space.counts(text)
        if c not in self.known:
            if len(self.known) >= _CACHE:
                self.known.clear()
            self.known[c] = self.index.score(c)
        return self.known[c]


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, score, predicted, evidence.

    Null and empty texts, like all without a marking term, score the share of
    label 1 among such examples and have no evidence.  Repeated rows score
    alike; null ids stay; an empty table gives an empty result; other columns
    are ignored, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in small_batches(batches):
            s = [scorer(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x for x, _ in s], pa.float64()), pa.array([x for _, x in s], pa.string())],
                names=["doc_id", "score", "evidence"])

    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = bounded_batches(d).mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, score double, evidence string")
    return out.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def drop_toxic(docs: DataFrame, index: Index, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, unchanged; only the
    text visits Python, and no row moves.  Null and empty texts score as in
    ``score``; repeated rows stay or go together; an empty table stays empty;
    columns may have any names."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.Series([scorer(t)[0] < threshold for t in texts.tolist()], dtype=bool)

    return bounded_batches(docs).filter(F.pandas_udf(clean, "boolean")(F.col(f"`{text_col}`").cast("string")))
