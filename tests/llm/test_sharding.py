from collections import Counter

import pytest

from textprofile.llm import sharding as S

from .frames import awkward, empty


def test_table_is_full_even_and_stable():
    names = [f"s{i}" for i in range(7)]
    size = S.table_size_for(7)
    table = S.fill_table(names, size)
    share = Counter(table)
    assert set(share) == set(range(7)) and max(share.values()) - min(share.values()) <= 1
    fewer = S.fill_table(names[:-1], size)  # a shard goes: the others keep most of their slots
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 0.25 * size


def test_turns_by_hand():
    """The first claims are the shards' own first choices, in turn."""
    size, names = 11, ["a", "b", "c"]
    table = S.fill_table(names, size)
    free, at = [-1] * size, 0
    prefs = []
    for n in names:
        o, st = S._h32("offset:" + n) % size, S._h32("stride:" + n) % (size - 1) + 1
        prefs.append([(o + j * st) % size for j in range(size)])
    while -1 in free:
        i = at % 3
        free[next(p for p in prefs[i] if free[p] < 0)] = i
        at += 1
    assert free == table


def test_bad_parameters():
    for names, size in (([], 7), (["a", "a"], 7), (["a"], 8), (["a"] * 2, 2_000_029)):
        with pytest.raises(ValueError):
            S.fill_table(names, size)


def test_awkward_rows(spark):
    df = awkward(spark)
    out = S.assign_shards(df, "doc_id", ["a", "b", "c"], slot_col="slot")
    assert out.count() == df.count()
    assert sorted(out.columns) == sorted(df.columns)  # shard and slot replaced, all else kept
    rows = out.collect()
    by = {}
    for r in rows:
        if r["doc_id"] is not None:
            by.setdefault(r["doc_id"], set()).add(r["shard"])
    assert all(len(v) == 1 for v in by.values())
    assert all(0 <= r["shard"] < 3 for r in rows)
    assert S.assign_shards(empty(spark), "doc_id", ["a"]).count() == 0


def test_rows_without_key_spread(spark):
    df = spark.range(3000).selectExpr("cast(null as bigint) as doc_id", "cast(id as string) as text")
    share = Counter(r["shard"] for r in S.assign_shards(df, "doc_id", [f"s{i}" for i in range(8)]).collect())
    assert len(share) == 8 and max(share.values()) < 2 * 3000 / 8


def test_write_shards(spark, tmp_path):
    df = S.assign_shards(spark.range(500).withColumnRenamed("id", "doc_id"), "doc_id", ["a", "b"])
    S.write_shards(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 2


def test_query_spreads_rows_without_id(spark, tmp_path):
    from textprofile.llm import queries

    df = spark.range(900).selectExpr("if(id % 3 = 0, null, id) as doc_id", "concat('text ', id) as text")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op1_sharding(spark, str(tmp_path))
    assert out.columns == ["doc_id", "slot", "shard"] and out.count() == 900
    shares = Counter(r["shard"] for r in out.filter("doc_id is null").collect())
    assert len(shares) == len(queries.SHARDS) and max(shares.values()) < 60
