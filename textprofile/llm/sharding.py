"""Shard placement by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a table whose size is a
prime (offset and stride from the MD5 of the shard's name).  The shards take
turns; on its turn a shard claims the first slot of its permutation that is
still free, until the table is full.  A key's slot is its hash modulo the table
size, and the slot's owner is its shard: constant-time placement by a broadcast
of the table.  Shares differ by at most one slot, and when a shard is added or
removed few keys move between the others.

The table depends on the shard names and the table size only, never on the
rows, so its broadcast has a fixed bound (``table_size`` rows).
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, hash60

#: A table never broadcasts more rows than this.
MAX_TABLE = 2_000_003


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def table_size_for(n_shards: int, slots_per_shard: int = 100) -> int:
    """The smallest prime of at least ``slots_per_shard`` slots a shard (the
    shares then differ by at most 1 %)."""
    n = max(2, n_shards * slots_per_shard)
    while not is_prime(n):
        n += 1
    return n


def _h32(s: str) -> int:
    return int(hashlib.md5(s.encode()).hexdigest()[:8], 16)


def fill_table(shards: Sequence[str], size: int) -> list[int]:
    """Owner (position in ``shards``) of each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct and at least one")
    if not is_prime(size) or size < len(shards) or size > MAX_TABLE:
        raise ValueError(f"the table size must be a prime between the number of shards and {MAX_TABLE}")
    slot = [_h32("offset:" + s) % size for s in shards]
    stride = [_h32("stride:" + s) % (size - 1) + 1 for s in shards]
    owner = [-1] * size
    for turn in range(size):
        i = turn % len(shards)
        while owner[slot[i]] >= 0:
            slot[i] = (slot[i] + stride[i]) % size
        owner[slot[i]] = i
    return owner


def lookup_table(spark: SparkSession, shards: Sequence[str], size: int) -> DataFrame:
    """(slot, shard) of the filled table, as a plan over one literal."""
    owners = ",".join(map(str, fill_table(shards, size)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "shard")) \
        .select(F.col("slot").cast("bigint").alias("slot"), F.col("shard").cast("bigint").alias("shard"))


def assign_shards(df: DataFrame, key: str, shards: Sequence[str], table_size: int | None = None,
                  shard_col: str = "shard", slot_col: str | None = None) -> DataFrame:
    """``df`` plus its shard (position in ``shards``), optionally its slot.

    No shuffle: a projection and one broadcast lookup.  Rows with the same key
    go to the same shard (ties and repeated rows alike).  A null key would send
    all such rows to one shard, so a row without key is placed by the hash of
    its other columns (maps left out).  An input column that already has the
    name of an output column is replaced.  An empty table stays empty."""
    size = table_size or table_size_for(len(shards))
    df = df.drop(*[c for c in df.columns if c.lower() in {shard_col.lower(), (slot_col or shard_col).lower()}
                   and c.lower() != key.lower()])
    kinds = dict(df.dtypes)
    rest = [F.col(f"`{c}`") for c in df.columns if c != key and "map<" not in kinds[c] and kinds[c] != "variant"]
    by_row = F.concat(F.lit("row:"), F.xxhash64(*rest).cast("string")) if rest else F.lit("row:")
    slot, owner, s = free_name(df, "_slot"), free_name(df, "_owner"), free_name(df, "_at")
    table = lookup_table(df.sparkSession, shards, size).select(F.col("slot").alias(s), F.col("shard").alias(owner))
    out = df.withColumn(slot, hash60(F.coalesce(F.col(f"`{key}`").cast("string"), by_row)) % size)
    out = out.join(F.broadcast(table), out[slot] == table[s]).drop(s)
    out = out.withColumnRenamed(slot, slot_col) if slot_col else out.drop(slot)
    return out.withColumnRenamed(owner, shard_col)


def write_shards(df: DataFrame, path: str, shard_col: str = "shard", files_per_shard: int = 8) -> None:
    """One folder a shard, each written by ``files_per_shard`` tasks (a round
    robin salt, so no shard is one task)."""
    salt = free_name(df, "_salt")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    (df.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files_per_shard)))
     .repartition(n, shard_col, salt).drop(salt).write.partitionBy(shard_col).parquet(path))


def oracle(shards: Sequence[str], size: int) -> str:
    """DuckDB SQL of the query: the same turns as a recursive fold over lists."""
    names = ", ".join(f"'{s}'" for s in shards)
    h32 = "('0x' || substr(md5({}), 1, 8))::BIGINT"
    return f"""
WITH RECURSIVE names AS (SELECT unnest([{names}]) AS name, generate_subscripts([{names}], 1) - 1 AS i),
perm AS (SELECT i, {h32.format("'offset:' || name")} % {size} AS o, {h32.format("'stride:' || name")} % {size - 1} + 1 AS st
         FROM names),
prefs AS (SELECT list(p ORDER BY i) AS lists FROM (
            SELECT i, list((o + j * st) % {size} ORDER BY j) AS p FROM perm, range({size}) r(j) GROUP BY i)),
fill(turn, owner, slot) AS (
  SELECT 0::BIGINT, list_transform(range({size}), lambda x: -1::BIGINT), -1::BIGINT
  UNION ALL
  SELECT turn + 1, owner[1:s] || [turn % {len(shards)}] || owner[s + 2:], s
  FROM (SELECT turn, owner, list_filter(lists[turn % {len(shards)} + 1], lambda x: owner[x + 1] < 0)[1] AS s
        FROM fill, prefs WHERE turn < {size})),
tab AS (SELECT slot, (turn - 1) % {len(shards)} AS shard FROM fill WHERE slot >= 0),
docs AS (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT % {size} AS slot FROM documents)
SELECT doc_id, docs.slot AS slot, shard::BIGINT AS shard FROM docs JOIN tab ON docs.slot = tab.slot
"""
