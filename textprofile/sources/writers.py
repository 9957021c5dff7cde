"""Sinks: feature groups, corpora, ARFF, the embedding store, experiment log,
fold reports.  All writes are distributed DataFrame writes."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Plain CSV text round-trips exactly with these options (no whitespace trim,
# doubled quotes, multi-line fields quoted).
CSV_WRITE = dict(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                 ignoreTrailingWhiteSpace=False, emptyValue="")

STORE_PARTITIONS = ("dataset", "encoder", "pool", "mode")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", header: bool = True) -> None:
    opts = dict(CSV_WRITE)
    opts["header"] = header
    df.write.mode(mode).options(**opts).csv(path)


def write_features(df: DataFrame, root: str, group: str, key: str = "author_id", fmt: str = "csv",
                   mode: str = "overwrite") -> str:
    """Feature group ``author id + features`` under ``root/group``."""
    path = f"{root.rstrip('/')}/{group}"
    out = df.select(key, *[c for c in df.columns if c != key])
    if fmt == "parquet":
        out.write.mode(mode).parquet(path)
    else:
        write_csv(out, path, mode)
    return path


def write_bucketed(df: DataFrame, root: str, group: str, key: str = "author_id", buckets: int = 32) -> str:
    """Feature group as a Parquet table bucketed and sorted by author, its
    columns doubles; returns the table's name.  Groups with the same number of
    buckets join on the author without an exchange.  Rows are dealt to the
    buckets before they are written, so there is one file a bucket.  A line of
    JSON beside the data says how it was bucketed, for ``readers.open_bucketed``."""
    name, path = bucketed_name(root, group), f"{root.rstrip('/')}/{group}"
    cols = [c for c in df.columns if c != key]
    out = df.select(F.col(key).cast("string").alias("author_id"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in cols])
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    (out.repartition(buckets, "author_id").write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, "author_id").sortBy("author_id").saveAsTable(name))
    spark.createDataFrame([(buckets, out.schema.json())], "buckets int, schema string").coalesce(1) \
        .write.mode("overwrite").json(f"{root.rstrip('/')}/_{group}_buckets")
    return name


def bucketed_name(root: str, group: str) -> str:
    """Name of a group's table in the session's catalog: one for each place."""
    return f"tp_{group}_{hashlib.md5(root.rstrip('/').encode()).hexdigest()[:12]}"


def write_arff(spark: SparkSession, rows: DataFrame, path: str, relation: str,
               attributes: Sequence[tuple[str, str]]) -> None:
    """ARFF relation: a header file (relation, attributes, ``@data``) and the
    data lines (one string column ``value``) written in parallel next to it."""
    header = [f"@relation {relation}", ""] + [f"@attribute {n} {t}" for n, t in attributes] + ["", "@data"]
    spark.createDataFrame([(h,) for h in header], "value string").coalesce(1) \
        .write.mode("overwrite").text(f"{path}/a_header")
    rows.select("value").write.mode("overwrite").text(f"{path}/b_data")


def write_embedding_store(df: DataFrame, root: str, mode: str = "overwrite", row_group_bytes: int | None = None) -> None:
    """``(author_id, chunk_no, layer, vec)`` rows partitioned by
    ``dataset/encoder/pool/mode``.  Rows are dealt by ranges of (store
    partition, layer, author), so a large partition is written by many tasks,
    and sorted by layer, so a layer filter skips files and row groups.  Every row
    group has a Bloom filter of its authors, so a reader of given authors skips
    those without them."""
    keys = [*STORE_PARTITIONS, "layer", "author_id"]
    w = (df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).partitionBy(*STORE_PARTITIONS)
         .option("parquet.bloom.filter.enabled#author_id", "true").option("parquet.bloom.filter.adaptive.enabled", "true"))
    if row_group_bytes:
        w = w.option("parquet.block.size", row_group_bytes)
    w.parquet(root)


#: Authors up to which a reader names them in the scan's filter.
MAX_NAMED = 10_000


def of_authors(store: DataFrame, authors: DataFrame, key: str = "author_id", max_named: int = MAX_NAMED) -> DataFrame:
    """The store's rows of the authors in column ``key`` of another table.  Up to
    ``max_named`` of them are named in the scan's filter, so row groups without
    them are never read (by their bounds and Bloom filters); more are joined,
    with a Bloom filter of the smaller side where Spark finds that worth it."""
    ids = authors.select(F.col(key).alias("_author")).filter("_author is not null").distinct()
    named = [r[0] for r in ids.limit(max_named + 1).collect()]
    if len(named) <= max_named:
        return store.filter(F.col(key).isin(named))
    return store.join(ids, F.col(key) == F.col("_author"), "left_semi")


def read_embeddings(spark: SparkSession, root: str, dataset: str, encoder: str, pool: str,
                    mode: str, layer: int | None = None, authors: DataFrame | None = None) -> DataFrame:
    """One store partition; the partition filters prune directories, the layer
    filter is pushed into the Parquet scan, and with ``authors`` (column
    ``author_id``) only their rows are read."""
    df = spark.read.parquet(root).filter(
        (F.col("dataset") == dataset) & (F.col("encoder") == encoder)
        & (F.col("pool") == pool) & (F.col("mode") == mode))
    if layer is not None:
        df = df.filter(F.col("layer") == layer)
    if authors is not None:
        df = of_authors(df, authors)
    return df.drop(*STORE_PARTITIONS)


def append_experiments(df: DataFrame, path: str) -> None:
    """Append-only experiment log (Parquet, partitioned by job id): no header
    bookkeeping, each append adds files."""
    df.write.mode("append").partitionBy("jobid").parquet(path)


def write_importance(imp: DataFrame, path: str) -> None:
    """Importance table ``(trait_no, trait, feature, importance)`` as CSV, the
    input of pictures; ordered within its files by trait and importance."""
    write_csv(imp.select("trait_no", "trait", "feature", "importance")
              .repartitionByRange("trait_no", F.col("importance").desc(), "feature")
              .sortWithinPartitions("trait_no", F.col("importance").desc(), "feature"), path)


def write_fold_report(results: DataFrame, path: str) -> DataFrame:
    """Per-trait report: fold accuracies in fold order and their mean."""
    rep = results.groupBy("trait").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("fold", "acc"))), lambda s: s["acc"]).alias("folds"),
        F.avg("acc").alias("mean_acc"))
    rep.write.mode("overwrite").json(path)
    return rep
