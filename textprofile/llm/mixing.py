"""Mixing sources to target weights by capped water-filling.

Targets: a total of ``share`` times all words is dealt to the sources in
proportion to their weights.  A source whose part exceeds ``max_epochs`` times
its own size is clamped there, and what it can't take is dealt again, by
weight, among the others, until no part is above its cap.

Sampling: a source's target is a number of epochs; its whole part repeats every
document, and the fractional part adds one repetition of some documents.  They
are the first in a seeded hash order until the words that are missing are
reached.  To find that point without sorting a source in one task, words are
summed by (source, leading bits of the hash); only the single bin in which the
target falls is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rank import global_position
from .common import WORD, free_name, hash60, materialize, whole

#: Bins of the hash order: 2**BIN_BITS for each source.
BIN_BITS = 12

#: What separates words (``WORD``).
BLANKS = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """Number of words: each, with the blanks after it, becomes one character.
    ``regexp_count`` would hold all words of a text as an array to take its size."""
    marks = F.regexp_replace(F.ltrim(text, F.lit(BLANKS)), f"{WORD}+[{BLANKS}]*+", ".")
    return F.length(marks).cast("bigint")


def hash_order(id_: Column, text: Column, seed: int) -> Column:
    """Seeded order of the rows: by id; rows without id by their text."""
    key = F.coalesce(id_.cast("string"), F.concat(F.lit("text:"), F.md5(text)))
    return hash60(F.concat(F.lit(f"mix-{seed}:"), key))


def water_fill(sources: DataFrame, total: float, max_epochs: int) -> DataFrame:
    """(source, weight, source_size) plus ``target``.

    Every round is one aggregate over the table of sources: ``level`` is what a
    unit of weight gets once the clamped sources have their caps.  The level
    only rises, so each source is clamped once and the rounds end.  A source
    without words gets 0; if the caps don't reach the total, all get their
    caps."""
    cap, level, before = F.col("source_size") * max_epochs, 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) >= cap
        s = sources.agg(F.sum(F.when(above, cap).otherwise(0)).alias("taken"), F.count_if(above).alias("n"),
                        F.sum(F.when(~above, F.col("weight")).otherwise(0)).alias("open")).first()
        if s["n"] == before or not s["open"]:
            break
        before, level = s["n"], (total - (s["taken"] or 0)) / s["open"]
    return sources.withColumn("target", F.when(F.col("weight") * F.lit(level) >= cap, cap.cast("double"))
                              .otherwise(F.col("weight") * F.lit(level)))


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int], share: float,
             max_epochs: int, seed: int, texts: bool) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` plus size, source_size, target and reps, under free names.

    Without ``texts`` only id and source are kept, and the texts are read once:
    their sizes and hash order are written, a few numbers a row, and the bins
    and both parts of the result start from there."""
    n = {k: free_name(docs, f"_mix_{k}") for k in
         ("u", "bin", "size", "source_size", "target", "whole", "need", "edge", "before", "src", "more", "at", "reps")}
    c = {k: F.col(v) for k, v in n.items()}
    src, text = F.col(f"`{source_col}`"), whole(f"`{text_col}`")
    d = docs.withColumn(n["size"], n_words(text)).withColumn(n["u"], hash_order(F.col(f"`{id_col}`"), text, seed)) \
        .withColumn(n["bin"], F.shiftright(c["u"], 60 - BIN_BITS))
    if not texts:
        kept = [f"`{k}`" for k in dict.fromkeys((id_col, source_col))]
        d = materialize(d.select(*kept, n["size"], n["u"], n["bin"]), "sizes")
    bins = materialize(d.groupBy(src.alias("source"), c["bin"].alias("bin")).agg(F.sum(c["size"]).alias("words")), "bins")
    sizes = bins.groupBy("source").agg(F.sum("words").alias("source_size")).withColumn("_null", F.col("source").isNull())
    sources = global_position(sizes, ["_null", "source"], "_rank").drop("_null").withColumn(
        "weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                               (F.col("_rank") % len(weights) + 1).cast("int")).cast("bigint")).drop("_rank")
    sources = materialize(sources, "sources")
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    targets = water_fill(sources, share * words, max_epochs).withColumn(
        "whole", F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size")))
        .cast("bigint")).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    # where each source's missing words end: a bin, and the words before it
    w = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = bins.withColumn("before", F.coalesce(F.sum("words").over(w), F.lit(0)))
    before = before.join(targets.select(F.col("source").alias("_s"), "need"), F.col("source").eqNullSafe(F.col("_s")))
    edge = before.filter("before < need").groupBy("source").agg(F.max("bin").alias("edge"), F.max("before").alias("before"))
    edge = edge.withColumnRenamed("source", "_s")
    t = targets.join(edge, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        F.col("source").alias(n["src"]), F.col("source_size").alias(n["source_size"]), F.col("target").alias(n["target"]),
        F.col("whole").alias(n["whole"]), F.col("need").alias(n["need"]),
        F.coalesce("edge", F.lit(-1)).alias(n["edge"]), F.coalesce("before", F.lit(0)).alias(n["before"]))
    d = d.join(materialize(t, "targets"), src.eqNullSafe(c["src"]))
    # only the bin in which the target falls needs the order of its rows
    w = Window.partitionBy(src).orderBy(c["u"], c["size"]).rowsBetween(Window.unboundedPreceding, -1)
    inside = d.filter(c["bin"] == c["edge"]).withColumn(n["at"], c["before"] + F.coalesce(F.sum(c["size"]).over(w), F.lit(0)))
    inside = inside.withColumn(n["more"], (c["need"] > 0) & (2 * c["at"] + c["size"] <= 2 * c["need"])).drop(n["at"])
    outside = d.filter(c["bin"] != c["edge"]).withColumn(n["more"], c["bin"] < c["edge"])
    return outside.unionByName(inside).withColumn(n["reps"], c["whole"] + c["more"].cast("bigint")), n


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: Sequence[int] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: int = 7) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken.

    Sources by code point (null is a source of its own, last) take the weights
    in turn.  A null or empty text has size 0.  The words that a source takes
    differ from its target by half of one document at most, and no document is
    taken more than ``max_epochs`` times.  The choice depends on seed, ids (for
    a null id: the text) and sizes alone, so reruns agree; rows that tie in all
    of them are alike, and how many of them are taken is fixed.  Empty tables
    give empty results; other columns are ignored, whatever their names."""
    out, n = _planned(docs, id_col, text_col, source_col, weights, share, max_epochs, seed, texts=False)
    size, reps = F.col(n["size"]), F.col(n["reps"])
    return out.select(F.col(f"`{id_col}`").alias("doc_id"), size.alias("size"),
                      F.col(n["source_size"]).alias("source_size"), F.col(n["target"]).alias("target"),
                      (reps * size).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: int = 7) -> DataFrame:
    """The mixed rows: every row as often as ``plan_mix`` takes it, with the
    columns of ``docs``.  No row moves but those of each source's edge bin."""
    out, n = _planned(docs, id_col, text_col, source_col, weights, share, max_epochs, seed, texts=True)
    times = F.when(F.col(n["reps"]) > 0, F.sequence(F.lit(1), F.col(n["reps"]).cast("int")))
    return out.withColumn(n["at"], F.explode(times)).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix-7:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))), 1, 15))::BIGINT AS u FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(sum(size)) OVER ()::BIGINT AS words,
         [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1]::BIGINT AS weight
  FROM d GROUP BY source),
lev AS (  -- level at which the sources up to this one, by cap over weight, are clamped
  SELECT *, 2 * source_size AS cap, coalesce(sum(2 * source_size) OVER w, 0)::BIGINT AS clamped,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open
  FROM src WINDOW w AS (ORDER BY 2 * source_size / weight, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT max((1.5::DOUBLE * words - clamped) / open) AS l FROM lev),
tgt AS (SELECT source, source_size, CASE WHEN weight * l >= cap THEN cap::DOUBLE ELSE weight * l END AS target
        FROM lev, level),
f AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END::BIGINT AS whole FROM tgt),
cum AS (SELECT doc_id, size, source_size, target, whole, target - whole * source_size AS need,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY u, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                  0)::BIGINT AS before
       FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target,
       size * (whole + CASE WHEN need > 0 AND 2 * before + size <= 2 * need THEN 1 ELSE 0 END) AS taken
FROM cum
"""
