"""A read-through cache that knows its input.

An entry's key is made of the input files (names, sizes, times of change) and
the parameters, so a changed input or parameter is computed anew.  The result is
written to a folder of its own first; a manifest that names it is put in place
by one rename afterwards.  Only what a manifest names is ever read: a write that
was interrupted leaves a folder that nobody knows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def files_fingerprint(df: DataFrame) -> str:
    """Number and order-free hashes of (name, size, time of change) of the files
    that ``df`` reads.  The files are looked up by tasks and not opened."""
    files = df.inputFiles()
    if not files:
        raise ValueError("the input reads no files; name its version among the parameters and give no inputs")
    seen = df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(files)
    h = [F.xxhash64(F.lit(i), "path", "length", F.col("modificationTime").cast("string")) for i in range(2)]
    r = seen.agg(F.count("*").alias("n"), *[F.bit_xor(x).alias(f"h{i}") for i, x in enumerate(h)]).first()
    return f"{r['n']}:{r['h0']}:{r['h1']}"


def cache_key(inputs: Mapping[str, DataFrame], params: Mapping[str, object]) -> str:
    said = {"inputs": {k: files_fingerprint(v) for k, v in inputs.items()}, "params": {k: repr(v) for k, v in params.items()}}
    return hashlib.sha256(json.dumps(said, sort_keys=True).encode()).hexdigest()[:32]


def published(spark: SparkSession, root: str, key: str) -> str | None:
    """The folder that the manifest of ``key`` names."""
    fs, path = _fs(spark, f"{root.rstrip('/')}/manifest/{key}.json")
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text)["data"]


def _publish(spark: SparkSession, root: str, key: str, data: str) -> str:
    """Put the manifest in place; if another writer was first, its folder holds."""
    fs, final = _fs(spark, f"{root.rstrip('/')}/manifest/{key}.json")
    _, draft = _fs(spark, f"{root.rstrip('/')}/draft/{key}-{uuid.uuid4().hex}")
    fs.mkdirs(final.getParent())
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps({"data": data, "key": key}).encode()))
    finally:
        out.close()
    if not fs.exists(final) and fs.rename(draft, final):
        return data
    fs.delete(draft, False)
    return published(spark, root, key) or data


def cached(spark: SparkSession, root: str, inputs: Mapping[str, DataFrame], params: Mapping[str, object],
           compute: Callable[[], DataFrame]) -> DataFrame:
    """``compute()``, or what it gave for the same files and parameters."""
    key = cache_key(inputs, params)
    data = published(spark, root, key)
    if data is None:
        data = f"{root.rstrip('/')}/data/{key}-{uuid.uuid4().hex[:8]}"
        compute().write.parquet(data)
        data = _publish(spark, root, key, data)
    return spark.read.parquet(data)
