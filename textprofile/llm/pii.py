"""Personal data: base patterns and a skip-chain conditional random field.

Base spans (email, ip, card, phone) come from patterns and checks; see
``base_spans``.  The field adds what the patterns miss, such as a number that
is written again without its prefix.

Graph of a document: its nodes are the tokens (runs of non-space) that hold a
digit or ``@``, and the tokens that repeat the key of a base token; all other
tokens are fixed to *none*.  Neighbouring tokens share a chain potential.
Tokens with the same key (letters and digits without case and punctuation; of
an email its local part) share a skip potential, each with the one before it,
however far apart, so the links grow with the tokens and not with their pairs.
Nodes inside base spans are fixed to their kind.  Damped loopy sum-product
messages run over all links of a batch at once; a free node whose most likely
label is not *none*, by half or more, becomes part of an added span.

The weights are learned by pseudo-likelihood (numpy gradient steps) from the
base labels of a bounded sample of documents (``MAX_DOCS``, ``MAX_BYTES`` in
the mean).  Every whole text is searched.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, hash60, small_batches, whole

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)  # 0: none
FEATURES, ROUNDS, DAMPING, EPOCHS, RATE, DECAY = 1 << 12, 12, 0.3, 60, 0.5, 1e-4
MAX_DOCS, MAX_BYTES = 2_000, 12_000_000
PULL = 2.0  # prior weight for equal labels over a skip link
MIN_KEY = 4  # shorter keys repeat by chance

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# Possessive where what follows can't begin with what was taken: same matches, linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NODE = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, last = 0, -1
    at = text.find("@")
    while at >= 0:
        run = text[max(done, last + 1):at]
        start = max(done, last + 1) + len(run.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        last = at
        at = text.find("@", at + 1)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans by start, then kind."""
    out = []
    if not text:
        return out
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def key_of(token: str) -> str:
    """What a token is compared by."""
    return "".join(c for c in token.split("@")[0].casefold() if c.isalnum())


def _shape(token: str) -> str:
    s = re.sub(r"[0-9]+", lambda m: f"9{len(m[0])}", token[:40])
    return re.sub(r"[^\W\d_]+", "a", s)


def _features(token: str, before: str, after: str) -> list[int]:
    digits = len(_DIGITS.findall(token))
    said = ["bias", "s:" + _shape(token), "b:" + _shape(before), "a:" + _shape(after), f"d:{min(digits, 20)}",
            f"@:{'@' in token}", f".:{min(token.count('.'), 4)}", f"l:{any(c.isalpha() for c in token)}",
            f"n:{min(len(token), 24)}"]
    return [zlib.crc32(s.encode("utf-8", "surrogatepass")) % FEATURES for s in said]


class Graph(NamedTuple):
    spans: list[tuple[int, int]]          # of the nodes
    features: list[list[int]]
    labels: list[int]                     # 0 for tokens outside base spans
    chain: list[tuple[int, int]]          # neighbours, in order
    skip: list[tuple[int, int]]           # a token and the one before it with its key
    edges: list[tuple[bool, bool]]        # a fixed token stands before, after


def graph_of(text: str, base: list[tuple[int, int, int]]) -> Graph | None:
    """The document's graph; None without nodes."""
    if not _NODE.search(text):
        return None
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    words = [text[a:b] for a, b in tokens]
    labels, i = [0] * len(tokens), 0
    for a, k, b in base:
        while i and tokens[i - 1][1] > a:
            i -= 1
        while i < len(tokens) and tokens[i][1] <= a:
            i += 1
        j = i
        while j < len(tokens) and tokens[j][0] < b:
            labels[j] = labels[j] or k + 1
            j += 1
    known = {k for w, y in zip(words, labels) if y and len(k := key_of(w)) >= MIN_KEY}
    nodes = [i for i, w in enumerate(words) if labels[i] or _NODE.search(w) or known and key_of(w) in known]
    at = {t: n for n, t in enumerate(nodes)}
    chain = [(at[t], at[t + 1]) for t in nodes if t + 1 in at]
    edges = [(t - 1 not in at, t + 1 not in at) for t in nodes]
    skip, last = [], {}
    for n, t in enumerate(nodes):
        k = key_of(words[t])
        if len(k) >= MIN_KEY:
            if k in last:
                skip.append((last[k], n))
            last[k] = n
    f = [_features(words[t], words[t - 1] if t else "", words[t + 1] if t + 1 < len(words) else "") for t in nodes]
    return Graph([tokens[t] for t in nodes], f, [labels[t] for t in nodes], chain, skip, edges)


class Batch:
    """The graphs of several documents as one set of arrays."""

    def __init__(self, graphs: list[Graph]):
        start = np.cumsum([0, *[len(g.spans) for g in graphs]])
        flat = lambda f: [x for g in graphs for x in f(g)]
        pairs = lambda f: np.array([(a + s, b + s) for g, s in zip(graphs, start) for a, b in f(g)],
                                   dtype=np.int64).reshape(-1, 2)
        self.start, self.n = start, int(start[-1])
        self.features = np.array(flat(lambda g: g.features), dtype=np.int64).reshape(self.n, -1 if self.n else 1)
        self.labels = np.array(flat(lambda g: g.labels), dtype=np.int64)
        self.chain, self.skip = pairs(lambda g: g.chain), pairs(lambda g: g.skip)
        self.edges = np.array(flat(lambda g: g.edges), dtype=bool).reshape(-1, 2)


class Field:
    """unary (FEATURES x LABELS), chain (LABELS x LABELS), skip (symmetric)."""

    def __init__(self) -> None:
        self.unary = np.zeros((FEATURES, LABELS))
        self.chain, self.skip = np.zeros((LABELS, LABELS)), PULL * np.eye(LABELS)

    def local(self, b: Batch) -> np.ndarray:
        """Scores of each node from its features and from fixed neighbours."""
        u = self.unary[b.features].sum(axis=1) if b.n else np.zeros((0, LABELS))
        return u + b.edges[:, :1] * self.chain[0][None, :] + b.edges[:, 1:] * self.chain[:, 0][None, :]

    def fit(self, b: Batch, epochs: int = EPOCHS, rate: float = RATE) -> "Field":
        """Gradient steps on the pseudo-likelihood of the labels: each node
        given its features and its neighbours' labels."""
        if not b.n:
            return self
        y, one = b.labels, np.eye(LABELS)
        g2 = [np.full_like(w, 1e-8) for w in (self.unary, self.chain, self.skip)]
        for _ in range(epochs):
            z = self.local(b)
            np.add.at(z, b.chain[:, 1], self.chain[y[b.chain[:, 0]]])
            np.add.at(z, b.chain[:, 0], self.chain[:, y[b.chain[:, 1]]].T)
            np.add.at(z, b.skip[:, 1], self.skip[y[b.skip[:, 0]]])
            np.add.at(z, b.skip[:, 0], self.skip[y[b.skip[:, 1]]])
            p = np.exp(z - z.max(axis=1, keepdims=True))
            d = (p / p.sum(axis=1, keepdims=True) - one[y]) / b.n
            gu, gc, gs = (np.zeros_like(w) for w in (self.unary, self.chain, self.skip))
            for j in range(b.features.shape[1]):
                np.add.at(gu, b.features[:, j], d)
            np.add.at(gc, y[b.chain[:, 0]], d[b.chain[:, 1]])
            np.add.at(gc.T, y[b.chain[:, 1]], d[b.chain[:, 0]])
            gc[0] += (d * b.edges[:, :1]).sum(axis=0)
            gc[:, 0] += (d * b.edges[:, 1:]).sum(axis=0)
            np.add.at(gs, y[b.skip[:, 0]], d[b.skip[:, 1]])
            np.add.at(gs, y[b.skip[:, 1]], d[b.skip[:, 0]])
            gs = (gs + gs.T) / 2
            prior = (0, 0, PULL * one)  # where few tokens repeat, the skip weights stay near it
            for w, g, s, w0 in zip((self.unary, self.chain, self.skip), (gu, gc, gs), g2, prior):
                g += DECAY * (w - w0)
                s += g * g
                w -= rate * g / np.sqrt(s)
        return self

    def marginals(self, b: Batch, rounds: int = ROUNDS) -> np.ndarray:
        """Beliefs after damped loopy sum-product rounds; base nodes are fixed."""
        u = self.local(b)
        fixed = b.labels > 0
        u[fixed] = -1e3
        u[fixed, b.labels[fixed]] = 0
        links = np.concatenate([b.chain, b.skip])
        source = np.concatenate([links[:, 0], links[:, 1]])
        target = np.concatenate([links[:, 1], links[:, 0]])
        back = np.concatenate([np.arange(len(links)) + len(links), np.arange(len(links))])
        table = np.concatenate([np.repeat(self.chain[None], len(b.chain), 0), np.repeat(self.skip[None], len(b.skip), 0),
                                np.repeat(self.chain.T[None], len(b.chain), 0), np.repeat(self.skip[None], len(b.skip), 0)])
        m = np.zeros((len(source), LABELS))
        for _ in range(rounds if len(links) else 0):
            belief = u.copy()
            np.add.at(belief, target, m)
            z = (belief[source] - m[back])[:, :, None] + table
            top = z.max(axis=1)
            new = top + np.log(np.exp(z - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            m = DAMPING * m + (1 - DAMPING) * new
        belief = u.copy()
        if len(links):
            np.add.at(belief, target, m)
        p = np.exp(belief - belief.max(axis=1, keepdims=True)) if b.n else belief
        return p / p.sum(axis=1, keepdims=True) if b.n else p


def added_spans(graph: Graph, p: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of neighbouring free nodes with one label, off the base spans."""
    out: list[tuple[int, int, int]] = []
    follows = {b: a for a, b in graph.chain}
    last = -1
    for n, ((a, b), y) in enumerate(zip(graph.spans, graph.labels)):
        k = int(p[n].argmax())
        if y or not k or p[n, k] < 0.5:
            continue
        if out and follows.get(n) == last and out[-1][1] == k - 1:
            out[-1] = (out[-1][0], k - 1, b)
        else:
            out.append((a, k - 1, b))
        last = n
    return [s for s in out if not any(s[0] < b and a < s[2] for a, _, b in base)]


def annotate(texts: list[str | None], field: Field) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    base = [base_spans(t) for t in texts]
    graphs = [graph_of(t or "", s) for t, s in zip(texts, base)]
    with_nodes = [i for i, g in enumerate(graphs) if g]
    batch = Batch([graphs[i] for i in with_nodes])
    p = field.marginals(batch)
    added: list[list] = [[] for _ in texts]
    for j, i in enumerate(with_nodes):
        added[i] = added_spans(graphs[i], p[batch.start[j]:batch.start[j + 1]], base[i])
    return list(zip(base, added))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS,
        max_bytes: int = MAX_BYTES) -> Field:
    """A field learned from the base labels of a sample of the documents that
    have nodes (by a hash of id and text).  Without any, the empty field, which
    adds nothing."""
    d = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), whole(F.col(f"`{text_col}`").cast("string")).alias("text"))
    d = d.filter(F.col("text").rlike("[0-9@]"))
    n, size = d.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    part = min(1.0, max_docs / max(n, 1), max_bytes / max(size or 0, 1))
    key = F.concat(F.lit("field:"), F.coalesce("id", F.lit("")), F.md5("text"))
    rows = d.filter(hash60(key) <= int(part * ((1 << 60) - 1))).collect()
    texts = sorted((r["id"] or "", r["text"]) for r in rows)
    return Field().fit(Batch([g for _, t in texts if (g := graph_of(t, base_spans(t)))]))


def find_personal_data(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone (base
    spans), base_sha256, spans (base and added), n_added.

    Null and empty texts have no spans.  Ties in start go by kind.  Repeated
    rows give equal rows, null ids stay, an empty table gives an empty result;
    other columns are ignored, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            found = annotate(b.column(1).to_pylist(), shared.value)
            counts = [pa.array([sum(k == i for _, k, _ in base) for base, _ in found], pa.int64()) for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *counts,
                 pa.array([hashlib.sha256(told(base).encode()).hexdigest() for base, _ in found], pa.string()),
                 pa.array([told(base + added) for base, added in found], pa.string()),
                 pa.array([len(added) for _, added in found], pa.int64())],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return bounded_batches(d).mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, " + ", ".join(f"n_{k} bigint" for k in KINDS)
                        + ", base_sha256 string, spans string, n_added bigint")
