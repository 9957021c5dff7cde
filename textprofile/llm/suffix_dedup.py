"""Removal of repeated byte strings by distributed prefix doubling.

A byte goes if it is covered by a string of ``threshold`` bytes that also starts
earlier: in a document of smaller id, or earlier in the same document.  A
*window* is such a string's start.

Prefix doubling ranks positions by their first h bytes: Spark sorts the pairs
(rank of i, rank of i + h - overlap) and gives equal pairs one new rank, which
is the rank by twice the length, until the rank is unique or the length is past
the threshold.  Positions are spread by ranges of (pair, document, position), so
a pair that a third of all rows share fills many tasks; a group that goes on
from one range to the next is joined through two rows a range.

Sorting every byte of a corpus would move it dozens of times, so positions
that are settled from the outset are not sorted:

1. Every window holds a sampled position, the least hash of the ``gram``-byte
   strings inside it, at the same place in equal windows.  Only these (about one
   in twenty bytes) enter the first sort, by the rank of their gram and, past
   the threshold, of their context: all bytes of all windows that may choose
   this position.  A gram met once: its windows are unique.  An equal context
   met earlier: its windows all start earlier.
2. What is left, windows of positions whose gram is shared but whose context is
   not (the edges of repeats), is ranked by doubling from ``start`` bytes on
   (half of the threshold unless given: smaller starts give more rounds, of
   which the first ones hardly settle anything here).

Nothing is capped; a hot gram only makes more windows of the second kind.
Initial ranks are 64-bit fingerprints of their bytes, contexts have one more;
all later ranks are exact places in the sorted order.
"""

from __future__ import annotations

import gc
import hashlib
import time
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmaps_of, free_name, materialize, small_batches, whole, with_bit
from .exact_dedup import filter_bits

THRESHOLD = 100
#: Bytes of a text that are ranked at once, so that very long texts need bounded memory.
SEGMENT = 1 << 20
_LOW = np.uint64((1 << 24) - 1)  # the place inside a segment
_BASE = 0x9E3779B97F4A7C15
_ROW = 40  # bits of a row's number inside its range


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def names(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit fingerprint of the ``length`` bytes from every position on that
    has so many: polynomials over the bytes' random values, put together from
    powers of two."""
    if len(data) < length:
        return np.zeros(0, dtype=np.uint64)
    h, out, done, c = _BYTE[data], None, 0, 1
    while True:
        if length & c:
            if out is None:
                out, done = h, c
            else:
                m = len(data) - done - c + 1
                out, done = out[:m] * np.uint64(pow(_BASE, c, 1 << 64)) + h[done:done + m], done + c
        if 2 * c > length:
            return out
        h = h[:-c] * np.uint64(pow(_BASE, c, 1 << 64)) + h[c:]
        c *= 2


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    n, m = 1, keys
    while n * 2 <= width:
        m, n = np.minimum(m[:-n], m[n:]), n * 2
    rest = width - n
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def sampled(data: np.ndarray, threshold: int, gram: int) -> tuple[np.ndarray, ...]:
    """(gram name, context name, first window, windows) of every sampled
    position of a text: the windows that choose it are neighbours."""
    out: list[tuple[np.ndarray, ...]] = []
    width, n, last = threshold - gram + 1, len(data), -1
    for at in range(0, max(0, n - threshold + 1), SEGMENT):
        # this segment's windows, with the bytes of all contexts around them
        lo, hi = max(0, at - threshold), min(n, at + SEGMENT + 2 * threshold)
        h = names(data[lo:hi], gram)
        own = h[at - lo:min(at + SEGMENT + width - 1, n - gram + 1) - lo]
        keys = own * np.uint64(_BASE) & ~_LOW
        keys |= np.arange(len(own), dtype=np.uint64)
        chosen = (_sliding_min(keys, width) & _LOW).astype(np.int64) + at
        first = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
        many, place = np.diff(np.append(first, len(chosen))), chosen[first]
        first = first + at
        if place[0] == last:  # the windows of a position go on from the segment before
            out[-1][3][-1] += many[0]
            first, many, place = first[1:], many[1:], place[1:]
        if len(place):
            last = int(place[-1])
            a, b = np.maximum(place - width + 1, 0), np.minimum(place + threshold, n)
            ctx = _mix(((place - a) * 1_000_003 + (b - place)).astype(np.uint64))
            for j in range(-(-(2 * threshold - gram) // gram)):
                ctx = _mix(ctx * np.uint64(_BASE) + h[np.minimum(a + gram * j, b - gram) - lo])
            out.append((h[place - lo], ctx, first, many))
    if not out:
        return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*out))


def lengths_of(threshold: int, start: int) -> list[int]:
    """Lengths that the ranks grow through: doubled, then the threshold."""
    out = [min(start, threshold)]
    while out[-1] < threshold:
        out.append(min(2 * out[-1], threshold))
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of every text, without a copy."""
    c = column.cast(pa.large_binary())
    ends = np.frombuffer(c.buffers()[1], dtype=np.int64, count=len(c) + 1, offset=8 * c.offset)
    raw = c.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        yield data[a:b]


def _key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, h, text): h tells rows apart that share an id or have none; where
    ids are unique it is 0."""
    d = docs.select(F.col(f"`{id_col}`").alias("doc"), whole(F.col(f"`{text_col}`").cast("string")).alias("text"))
    twice = d.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1 or doc is null")
    h = F.lit(0).cast("bigint") if twice.isEmpty() else F.xxhash64("text")
    return d.select("doc", h.alias("h"), "text")


def _sampled_rows(docs: DataFrame, threshold: int, gram: int) -> DataFrame:
    """(g, c, doc, h, win): sampled positions; win holds the first window and
    the number of windows (16 bits)."""
    id_type = dict(docs.dtypes)["doc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for b in small_batches([whole_batch], 512):
                found = [sampled(t, threshold, gram) for t in _texts(b.column(2))]
                row = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
                g, c, first, many = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [_signed(g), _signed(c), b.column(0).take(row), b.column(1).take(row), pa.array(first << 16 | many)],
                    names=["g", "c", "doc", "h", "win"])

    return docs.filter(F.octet_length("text") >= threshold).mapInArrow(
        run, f"g bigint, c bigint, doc {id_type}, h bigint, win bigint")


def _ranges(df: DataFrame, *keys: str) -> DataFrame:
    """Sorted by keys, then document and place; spread by ranges of all of
    them, so that no key has to fit into one task."""
    order: list[Column] = [*map(F.col, keys), F.col("doc").asc_nulls_last(), F.col("h"), F.col(df.columns[-1])]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def _longs(b: pa.RecordBatch, *at: int) -> list[np.ndarray]:
    return [b.column(i).to_numpy(zero_copy_only=False) for i in at]


def _settle(rows: DataFrame) -> DataFrame:
    """(doc, h, win, again): of the sampled positions in the order of gram and
    context, those whose windows all start earlier (``again``), and those to be
    ranked: the first of a context, if its gram has others.

    The first and the last context of a range count as to be ranked, as their
    neighbours are in other ranges: ranking is exact for any surplus."""
    id_type = dict(rows.dtypes)["doc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sure, last = None, False, None  # a context's first row that waits for the next context
        for b in batches:
            if not b.num_rows:
                continue
            g, c = _longs(b, 0, 1)
            new_g = np.append(last is None or g[0] != last[0], g[1:] != g[:-1])
            new = new_g | np.append(last is None or c[0] != last[1], c[1:] != c[:-1])
            heads = np.flatnonzero(new)
            if len(heads):
                several = ~new_g[heads]
                several[0] |= last is None
                if held is not None and (sure or several[0]):
                    yield held
                yield _settled(b, heads[:-1][several[:-1] | several[1:]], False)
                held, sure = _settled(b, heads[-1:], False), bool(several[-1])
            yield _settled(b, np.flatnonzero(~new), True)
            last = int(g[-1]), int(c[-1])
        if held is not None:
            yield held

    return rows.mapInArrow(run, f"doc {id_type}, h bigint, win bigint, again boolean")


def _settled(b: pa.RecordBatch, at: np.ndarray, again: bool) -> pa.RecordBatch:
    i = pa.array(at)
    return pa.RecordBatch.from_arrays([*[b.column(k).take(i) for k in (2, 3, 4)], pa.array([again] * len(at), pa.bool_())],
                                      names=["doc", "h", "win", "again"])


def _windows(docs: DataFrame, todo: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """(a, b, doc, h, pos): the windows to be ranked, and the positions whose
    ranks theirs are made of, with the names of the first two pieces."""
    id_type, start = dict(docs.dtypes)["doc"], lengths[0]
    steps = [y - x for x, y in zip(lengths, lengths[1:])] or [0]
    also = {0}
    for s in steps[1:]:
        also |= {x + s for x in also}
    shifts, reach = np.array(sorted(also)), max(also) + steps[0] + start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for b in small_batches([whole_batch], 128):
                for i, (text, wins) in enumerate(zip(_texts(b.column(2)), b.column(3))):
                    win = np.sort(wins.values.to_numpy(zero_copy_only=False))
                    first, many = win >> 16, win & 0xFFFF
                    pos = np.repeat(first - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
                    pos = np.unique((pos[:, None] + shifts).reshape(-1))
                    cuts = np.searchsorted(pos, np.arange(0, len(text) + SEGMENT, SEGMENT))
                    for lo, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
                        if x < y:
                            at, p = lo * SEGMENT, pos[x:y]
                            name = names(text[at:at + SEGMENT + reach], start)
                            row = pa.array(np.full(len(p), i))
                            yield pa.RecordBatch.from_arrays(
                                [_signed(name[p - at]), _signed(name[p - at + steps[0]]), b.column(0).take(row), b.column(1).take(row),
                                 pa.array(p)], names=["a", "b", "doc", "h", "pos"])

    found = _joined(docs, todo.groupBy("doc", "h").agg(F.collect_list("win").alias("wins")))[0]
    return found.select("doc", "h", "text", "wins").mapInArrow(run, f"a bigint, b bigint, doc {id_type}, h bigint, pos bigint")


def _joined(docs: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` with their row of ``lists`` (one each), and the rows
    without.  Rows that a filter of the listed keys doesn't know never move."""
    lists = materialize(lists, "lists")
    bits = filter_bits(lists.count())
    bitmaps = materialize(bitmaps_of(lists.select(_cell(bits).alias("cell"))), "bitmaps")
    hit = free_name(docs, "_hit")
    d = with_bit(docs, _cell(bits), bitmaps, hit)
    mine = lists.withColumnsRenamed({"doc": "_doc", "h": "_h"})
    j = d.filter(F.col(hit)).join(mine, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_h")), "left")
    own = F.col("_h").isNotNull()
    return j.filter(own).drop("_doc", "_h", hit), d.filter(~F.col(hit)).drop(hit).unionByName(
        j.filter(~own).select(*docs.columns))


def _cell(bits: int) -> Column:
    return F.pmod(F.xxhash64("doc", "h"), F.lit(bits)) + 1


def ranked(pairs: DataFrame, again_only: bool = False) -> DataFrame:
    """(doc, h, pos, rank, again) of the positions whose pair (a, b) is not
    unique: positions have one rank if and only if their pairs are equal;
    ``again``: an earlier position has the same pair.

    The rank is the place of the pair's first position in the sorted order:
    the range, and the row in it.  Every range also gives its first and last
    pair; where a range goes on with the pair before, that pair's rank holds.
    ``again_only`` leaves out each pair's first position."""
    id_type, spark = dict(pairs.dtypes)["doc"], pairs.sparkSession
    cols = ["doc", "h", "pos", "rank", "again", "edge", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << _ROW
        n, held, held_new, last, head, final = 0, None, False, None, 0, None

        def rows(b: pa.RecordBatch, at: np.ndarray, rank: np.ndarray, new: np.ndarray) -> pa.RecordBatch:
            i, none = pa.array(at), pa.nulls(len(at), pa.int64())
            return pa.RecordBatch.from_arrays(
                [*[b.column(k).take(i) for k in (2, 3, 4)], pa.array(rank[at]), pa.array(~new[at]),
                 pa.array(np.zeros(len(at), np.int32)), none, none], names=cols)

        def edge(b: pa.RecordBatch, kind: int, rank: int, key: tuple[int, int]) -> pa.RecordBatch:
            none = b.slice(0, 1)
            return pa.RecordBatch.from_arrays(
                [none.column(2), none.column(3), none.column(4), pa.array([rank]), pa.array([False]),
                 pa.array([kind], pa.int32()), *[pa.array([k]) for k in key]], names=cols)

        for b in batches:
            if not b.num_rows:
                continue
            x, y = _longs(b, 0, 1)
            new = np.append(last is None or (x[0], y[0]) != last, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
            if last is None:
                yield edge(b, 1, base, (int(x[0]), int(y[0])))
            # the row number of each pair's first position; ``head`` is that of a pair that goes on
            rank = np.maximum.accumulate(np.where(new, np.arange(n, n + len(x)), head)) + base
            if held is not None and not (held_new and new[0]):
                yield held
            # a position is alone if a new pair starts at it and after it; the ends of a range are kept
            keep = ~(new[:-1] & new[1:])
            if last is None and len(keep):
                keep[0] = True
            if again_only:
                keep &= ~new[:-1] | (rank[:-1] == base)
            yield rows(b, np.flatnonzero(keep), rank, new)
            end = np.array([len(x) - 1])
            held = rows(b, end, rank, new)
            held_new = bool(new[-1]) and (again_only or last is not None or len(x) > 1)
            if again_only and new[-1] and rank[-1] != base:
                held = held.slice(0, 0)
            last, head, n, final = (int(x[-1]), int(y[-1])), int(rank[-1]) - base, n + len(x), b.slice(len(x) - 1)
        if held is not None:
            yield held
            yield edge(final, 2, head + base, last)

    out = materialize(_ranges(pairs, "a", "b").mapInArrow(
        run, f"doc {id_type}, h bigint, pos bigint, rank bigint, again boolean, edge int, a bigint, b bigint"), "ranks")
    known: dict[int, int] = {}  # two rows a range
    before: tuple | None = None
    for r in sorted(out.filter("edge > 0").select("edge", "rank", "a", "b").collect(), key=lambda r: (r["rank"] >> _ROW, r["edge"])):
        if r["edge"] == 1 and before and (r["a"], r["b"]) == before[1:]:
            known[r["rank"]] = before[0]
        if r["edge"] == 2:
            before = known.get(r["rank"], r["rank"]), r["a"], r["b"]
    out = out.filter("edge = 0").drop("edge", "a", "b")
    if known:
        m = F.broadcast(spark.createDataFrame(sorted(known.items()), "_rank bigint, _first bigint"))
        out = out.join(m, F.col("rank") == F.col("_rank"), "left").select(
            "doc", "h", "pos", F.coalesce("_first", "rank").alias("rank"), (F.col("again") | F.col("_first").isNotNull()).alias("again"))
    return out.filter("again") if again_only else out


_BLOCK = 14  # bits of a place inside a block


def next_pairs(ranks: DataFrame, step: int) -> DataFrame:
    """(a, b, doc, h, pos): the ranks of every position and of the one ``step``
    bytes on; positions without both are unique.  Texts are cut into blocks,
    and what a block needs of the next one is given to both."""
    block, low = F.shiftright("pos", _BLOCK), F.col("pos") % (1 << _BLOCK)
    reach = -(-step // (1 << _BLOCK))
    blocks = F.when(low < step, F.sequence(F.greatest(block - reach, F.lit(0)), block)).otherwise(F.array(block))
    r = ranks.select("doc", "h", "pos", "rank", F.explode(blocks).alias("block"))
    w = Window.partitionBy("doc", "h", "block").orderBy("pos").rangeBetween(step, step)
    r = r.withColumn("b", F.max("rank").over(w)).filter(F.col("b").isNotNull() & (F.col("block") == block))
    return r.select(F.col("rank").alias("a"), "b", "doc", "h", "pos")


def _merged(spans: DataFrame) -> DataFrame:
    """(doc, h, starts, ends): each document's spans (doc, h, first, end),
    overlapping and touching ones as one, in order."""
    id_type = dict(spans.dtypes)["doc"]
    cols = ["doc", "h", "starts", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, starts, ends = None, [], []  # the present document

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*key[1], pa.array([starts]), pa.array([ends])], names=cols)

        for b in batches:
            ids, (h, first, end) = b.column(0), _longs(b, 1, 2, 3)
            d = ids.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])))[: b.num_rows]
            for x, y in zip(cut.tolist(), [*cut[1:].tolist(), b.num_rows]):
                mine = ids[x].as_py(), int(h[x])
                if key is None or key[0] != mine:
                    if key is not None:
                        yield done()
                    key, starts, ends = (mine, (ids.slice(x, 1), b.column(1).slice(x, 1))), [], []
                top = np.maximum.accumulate(end[x:y])
                if ends:
                    top = np.maximum(top, ends[-1])
                breaks = np.append(not ends or first[x] > ends[-1], first[x + 1:y] > top[:-1])
                at = np.flatnonzero(breaks)
                if not breaks[0]:
                    ends[-1] = int(top[at[0] - 1] if len(at) else top[-1])
                starts += first[x:y][at].tolist()
                ends += top[np.append(at[1:] - 1, y - x - 1)].tolist() if len(at) else []
        if key is not None:
            yield done()

    n = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = spans.repartition(n, "doc", "h").sortWithinPartitions("doc", "h", "first")
    return s.mapInArrow(run, f"doc {id_type}, h bigint, starts array<bigint>, ends array<bigint>")


def _free(df: DataFrame) -> None:
    """Lets Spark's context cleaner remove the shuffle files of finished steps:
    it does so once their plans are garbage on both sides.  The first round
    releases what the second can find."""
    for _ in range(2):
        gc.collect()
        df.sparkSession._jvm.System.gc()
        time.sleep(1)


def repeated_spans(rows: DataFrame, threshold: int = THRESHOLD, gram: int | None = None, start: int | None = None) -> DataFrame:
    """(doc, h, starts, ends) of the documents with repeated bytes, for rows
    (doc, h, text) with unique (doc, h)."""
    if not 2 <= threshold < 1 << 15:
        raise ValueError("a threshold of 2 to 32,767 bytes")
    gram, start = gram or max(1, threshold * 5 // 8), start or -(-threshold // 2)
    lengths = lengths_of(threshold, start)
    settled = materialize(_settle(_ranges(_sampled_rows(rows, threshold, gram), "g", "c")), "settled")
    _free(rows)
    pairs = _windows(rows, settled.filter("not again"), lengths)
    steps = [y - x for x, y in zip(lengths, lengths[1:])]
    for step in steps[1:]:
        pairs = next_pairs(ranked(pairs), step)
        _free(rows)
    late = ranked(pairs, again_only=True)
    _free(rows)
    first = F.shiftright("win", 16)
    spans = settled.filter("again").select(
        "doc", "h", first.alias("first"), (first + F.col("win") % 65536 + (threshold - 1)).alias("end")).unionByName(
        late.select("doc", "h", F.col("pos").alias("first"), (F.col("pos") + threshold).alias("end")))
    return _merged(spans)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD,
                    gram: int | None = None, start: int | None = None, texts: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256,
    starts and ends of the removed runs (bytes, end exclusive), and with
    ``texts`` the remaining bytes as ``kept``.

    A byte goes if it is covered by a string of ``threshold`` bytes that also
    starts earlier.  Null texts count as empty.  Rows of one id are taken in the
    order of their texts' hashes, rows without id come last in the same order;
    of rows alike in id and text all but one count as copies of the first, so
    they lose everything (texts below the threshold nothing).  Texts below the
    threshold keep all.  An empty table gives an empty result; other columns are
    ignored, whatever their names."""
    base = _key(docs, id_col, text_col)
    twice = materialize(base.groupBy("doc", "h").agg(F.count("*").alias("n")).filter("n > 1")
                        .withColumnsRenamed({"doc": "_doc", "h": "_h"}), "twice")
    rows, copies = base, None
    if not twice.isEmpty():
        on = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_h"))
        more = materialize(base.join(twice, on).dropDuplicates(["doc", "h"]).drop("_doc", "_h"), "repeated")
        rows = base.join(twice, on, "left_anti").unionByName(more.drop("n"))
        again = more.withColumn("_i", F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))))
        size = F.octet_length("text").cast("bigint")
        cut = F.array(F.struct(F.lit(0).cast("bigint").alias("s"), size.alias("e")))
        cut = F.when(size >= threshold, cut).otherwise(F.slice(cut, 1, 0))
        copies = again.select("doc", "text", cut["s"].alias("starts"), cut["e"].alias("ends"))
    held, free = _joined(rows, repeated_spans(rows, threshold, gram, start))
    held = held.select("doc", "text", "starts", "ends")
    held = held if copies is None else held.unionByName(copies)
    id_type, kept_type = dict(base.dtypes)["doc"], ", kept binary" if texts else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for b in small_batches([whole_batch], 64):
                kept, gone = [], []
                for text, starts, ends in zip(_texts(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
                    bounds = [0, *[x for s in zip(starts, ends) for x in s], len(text)]
                    kept.append(b"".join(text[x:y].tobytes() for x, y in zip(bounds[::2], bounds[1::2])))
                    gone.append(len(text) - len(kept[-1]))
                out = [b.column(0), pa.array([len(k) + g for k, g in zip(kept, gone)], pa.int64()), pa.array(gone, pa.int64()),
                       pa.array([len(s) for s in b.column(2)], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                       b.column(2), b.column(3), *([pa.array(kept, pa.binary())] if texts else [])]
                yield pa.RecordBatch.from_arrays(out, names=[
                    "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends", *(["kept"] if texts else [])])

    cutted = held.mapInArrow(run, f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
                                  f"starts array<bigint>, ends array<bigint>{kept_type}")
    none, zero = F.array().cast("array<bigint>"), F.lit(0).cast("bigint")
    whole_rows = free.select(
        F.col("doc").alias("doc_id"), F.octet_length("text").cast("bigint").alias("n_bytes"), zero.alias("n_removed"),
        zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), none.alias("starts"), none.alias("ends"),
        *([F.encode("text", "utf-8").alias("kept")] if texts else []))
    return whole_rows.unionByName(cutted)
