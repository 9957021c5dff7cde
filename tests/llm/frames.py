"""Small inputs with the awkward cases."""

from pyspark.sql import types as T

LONG = " ".join(f"word{i % 977}" for i in range(30_000))

ROWS = [
    (1, "alpha beta gamma delta", "s1"), (2, "alpha beta gamma delta", "s1"), (3, None, "s1"), (4, "", None),
    (5, "   \n\t ", "s2"), (6, LONG, "s2"), (7, LONG, "s3"), (7, LONG, "s3"), (None, "no id at all", "s3"),
    (None, "no id at all", None), (None, None, None), (8, "alpha beta gamma delta epsilon", "s1"),
    (9, "\U0001f600 Ünïcode été ​", "s2"), (8, "another text of id 8", "s1"),
]

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
    # names that operators use for their own columns
    *[T.StructField(n, T.StringType()) for n in (
        "score", "fp", "row_hash", "component_id", "_bin", "size", "target", "_u", "shard", "slot", "_slot", "_hash",
        "possible", "text_sha256", "edits", "item_id", "bucket", "n", "y", "id", "root", "_mix_size", "kept",
        "_id", "_row_hash", "_gone_id", "_gone_sha", "_marked", "_marked_id", "_marked_hash", "_sha", "_doc", "_h", "_root",
        "_keep_id", "_keep_hash", "doc", "h", "conv", "_pid", "wins")],
])


def awkward(spark):
    extra = len(SCHEMA.fields) - 3
    return spark.createDataFrame([(*r, *["x"] * extra) for r in ROWS], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")
