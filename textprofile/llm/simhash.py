"""SimHash near-duplicates by covering locality-sensitive hashing.

Each document gets a 64-bit fingerprint: bit b is set if over half of its
shingles' XXH64 values have it set.  Fingerprints link at ``radius`` or fewer
differing bits.

Covering masks: bit i has a vector m(i) of radius + 1 bits; for each non-zero
vector v there is a table whose mask keeps the bits with <m(i), v> odd.  The
vectors of ``radius`` differing bits span at most ``radius`` dimensions, so
some v is orthogonal to them all, and that table's mask hides every differing
bit: a linked pair collides in some table for certain (2**(radius+1) - 1
tables, each with about half of the bits).

Only distinct fingerprints are compared.  A bucket of at most ``SMALL`` of
them compares its pairs.  In a larger bucket no pairs are made: two
fingerprints that differ in two bits or fewer share a *centre*, a fingerprint
that differs from each in one bit or none, so every member links to its
centres and a centre to its smallest member.  Both ways are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmaps_of, bounded_batches, free_name, materialize, small_batches, with_bit
from .components import components
from .exact_dedup import filter_bits

#: Distinct fingerprints in a bucket up to which its pairs are compared.
SMALL = 16
_CHUNK = 1 << 16  # shingles whose bits are unpacked at once


def shingle_hashes(text: str | None, n: int, seed: int = 42) -> list[bytes]:
    """Big-endian XXH64 of every word n-gram (repeats included) of the text,
    A-Z in lower case, words split at ASCII white space.  Fewer than n words:
    of the whole sequence; none: nothing."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[min(n, len(words)) - 1:]
    digest = xxhash.xxh64_digest
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends)]


def fingerprints(texts: list[str | None], n: int) -> np.ndarray:
    """The fingerprints as big-endian bytes (len(texts) x 8)."""
    ones = np.zeros((len(texts), 64), dtype=np.int64)
    counts = np.zeros(len(texts), dtype=np.int64)
    held: list[bytes] = []
    owner: list[tuple[int, int]] = []  # (text, shingles) of what is held

    def flush() -> None:
        bits = np.unpackbits(np.frombuffer(b"".join(held), dtype=np.uint8).reshape(-1, 8), axis=1)
        at = np.cumsum([0, *[k for _, k in owner[:-1]]])
        np.add.at(ones, [i for i, _ in owner], np.add.reduceat(bits, at, axis=0, dtype=np.int64))
        held.clear()
        owner.clear()

    for i, text in enumerate(texts):
        hashes = shingle_hashes(text, n)
        counts[i] = len(hashes)
        for a in range(0, len(hashes), _CHUNK):
            part = hashes[a:a + _CHUNK]
            held += part
            owner.append((i, len(part)))
            if len(held) >= _CHUNK:
                flush()
    if held:
        flush()
    return np.packbits(ones * 2 > counts[:, None], axis=1)


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(doc_id, fp, row_hash): fp is the fingerprint as a signed bigint,
    row_hash the XXH64 of the text (to tell rows of the same id apart)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            fp = fingerprints(b.column(1).to_pylist(), n)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(fp.reshape(-1).view(">i8").astype(np.int64)), b.column(2)],
                names=["doc_id", "fp", "row_hash"])

    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                    F.xxhash64(F.col(f"`{text_col}`")).alias("row_hash"))
    return bounded_batches(d).mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, fp bigint, row_hash bigint")


def covering_masks(radius: int) -> list[int]:
    """The table masks, as signed 64-bit integers."""
    vectors = range(1, 1 << (radius + 1))
    bit_vector = [1 + i % len(vectors) for i in range(64)]
    masks = [sum(1 << i for i in range(64) if bin(bit_vector[i] & v).count("1") % 2) for v in vectors]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def fingerprint_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links that connect exactly the distinct ``fp`` values of
    ``fps`` within ``radius`` (1 or 2) bits of each other, and no others."""
    if radius not in (1, 2):
        raise ValueError("centres one bit away cover a radius of 1 or 2")
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                       for t, m in enumerate(masks)])
    keyed = fps.select("fp", F.explode(tables).alias("k")).select("fp", F.col("k.t").alias("t"), F.col("k.key").alias("key"))
    buckets = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = materialize(buckets.select(F.col("t").alias("_t"), F.col("key").alias("_key"), "n"), "buckets")
    shared = materialize(keyed.join(buckets, (F.col("t") == F.col("_t")) & (F.col("key") == F.col("_key")))
                         .select("t", "key", "fp", "n"), "shared")
    # small buckets: their pairs, at most SMALL for each member
    small = shared.filter(F.col("n") <= SMALL).groupBy("t", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = small.select(F.explode("fps").alias("a"), "fps").select("a", F.explode(
        F.filter("fps", lambda x: (x < F.col("a")) & (_distance(x, F.col("a")) <= radius))).alias("b"))
    # large buckets: links to centres over the bits that the table's mask hides
    free = F.lit(None)
    for t, m in enumerate(masks):
        hidden = [1 << i for i in range(64) if not (m >> i) & 1]
        flips = F.array(F.lit(0).cast("bigint"), *[F.lit(b - (1 << 64) if b >> 63 else b).cast("bigint") for b in hidden])
        free = F.when(F.col("t") == t, flips).otherwise(free)
    centred = shared.filter(F.col("n") > SMALL).select("fp", F.explode(
        F.transform(free, lambda b: F.col("fp").bitwiseXOR(b))).alias("centre")).distinct()
    if radius == 2:
        hubs = materialize(centred.groupBy("centre").agg(F.min("fp").alias("least"), F.count("*").alias("n"))
                           .filter("n > 1").select(F.col("centre").alias("_centre"), "least"), "hubs")
    else:  # of two members one bit apart, one is the other's centre
        hubs = fps.select(F.col("fp").alias("_centre"), F.col("fp").alias("least"))
    stars = centred.join(hubs, F.col("centre") == F.col("_centre")).select(F.col("fp").alias("a"), F.col("least").alias("b"))
    return pairs.unionByName(stars).filter("a <> b").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                       radius: int = 2) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits),
    component_id (the smallest id reachable over links, itself included), root
    (the component's smallest fingerprint) and row_hash.

    Null and empty texts have fingerprint 0, linked like any other.  Equal
    fingerprints are linked; repeated rows share a component.  A null id is
    never the smallest; a component of null ids only has a null id.  Empty
    tables give empty results; other columns are ignored, whatever their
    names."""
    rows = materialize(with_fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = materialize(components(fingerprint_links(fps, radius)), "roots")
    cls = fps.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    cls = materialize(cls, "classes")
    ids = materialize(cls.groupBy("root").agg(F.min("least").alias("component_id"))
                      .withColumnRenamed("root", "_root"), "ids")
    cls = cls.join(ids, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "component_id", "root")
    out = rows.join(materialize(cls, "component"), F.col("fp") == F.col("_fp"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", "row_hash")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                         radius: int = 2) -> DataFrame:
    """One row of every component, with the columns of ``docs``: the one with
    the smallest id (of rows with that id, or without any, the smallest text
    hash).  Of rows alike in both, one.  Null and empty texts are one component;
    an empty table stays empty; columns may have any names."""
    rows = simhash_components(docs, id_col, text_col, shingle, radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")).alias("k")
    keep = materialize(rows.groupBy("root").agg(first, F.count("*").alias("n")).filter("n > 1").select(
        F.col("root").alias("_root"), F.col("k.doc_id").alias("_keep_id"), F.col("k.row_hash").alias("_keep_hash")), "kept")
    # rows of groups: those to drop, and those to keep once although repeated
    j = rows.join(keep, F.col("root") == F.col("_root"))
    kept = F.col("doc_id").eqNullSafe(F.col("_keep_id")) & (F.col("row_hash") == F.col("_keep_hash"))
    marked = j.groupBy("doc_id", "row_hash").agg(F.max(kept).alias("kept"), F.count("*").alias("n")).filter("not kept or n > 1")
    # names that no column of the documents has
    h, hit, mid, mhash = (free_name(docs, n) for n in ("_hash", "_marked", "_marked_id", "_marked_hash"))
    marked = materialize(marked.select(F.col("doc_id").alias(mid), F.col("row_hash").alias(mhash), "kept"), "marked")
    bits = filter_bits(marked.count())
    cell = lambda i, x: F.pmod(F.xxhash64(i, x), F.lit(bits)) + 1
    bitmaps = materialize(bitmaps_of(marked.select(cell(F.col(mid), F.col(mhash)).alias("cell"))), "bitmaps")
    d = docs.withColumn(h, F.xxhash64(F.col(f"`{text_col}`")))
    d = with_bit(d, cell(F.col(f"`{id_col}`"), F.col(h)), bitmaps, hit)
    # rows that the filter doesn't know stay where they are; only the others move
    on = F.col(f"`{id_col}`").eqNullSafe(F.col(mid)) & (F.col(h) == F.col(mhash))
    once = d.filter(hit).join(marked.filter("kept"), on, "left_semi").dropDuplicates([id_col, h])
    free = d.filter(hit).join(marked, on, "left_anti")
    return d.filter(~F.col(hit)).unionByName(free).unionByName(once).drop(h, hit)
