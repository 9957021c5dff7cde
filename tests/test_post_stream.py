import os
import shutil

import pytest

from textprofile.operators import cache as CA
from textprofile.operators import posts as P
from textprofile.streaming import posts as SP

SCHEMA = "author string, body string, created_utc long, id long"


def log(n=200):
    return [(f"a{i % 7}", f"post {i}", (i * 37) % 101, i) for i in range(n)] + [("hot", f"h{i}", i % 50, 1000 + i) for i in range(100)]


def write_files(spark, path, rows, files):
    """CSV files, every one with posts from all times; one file a write, as they arrive."""
    for f in range(files):
        spark.createDataFrame(rows[f::files], SCHEMA).coalesce(1).write.option("header", True).mode("append").csv(path)


def test_stream_equals_batch_and_state_is_bounded(spark, tmp_path):
    path, rows = str(tmp_path / "log"), log()
    state = SP.RecentPostsState(spark, str(tmp_path / "state"), n=5, tiebreak="id")
    write_files(spark, path, rows[:150], 3)
    SP.stream_recent_posts(spark, path, state, str(tmp_path / "ckpt"), keep={"id": "long"}, files_per_trigger=2)
    write_files(spark, path, rows[150:], 3)  # arrives later, with older and newer posts
    SP.stream_recent_posts(spark, path, state, str(tmp_path / "ckpt"), keep={"id": "long"}, files_per_trigger=1)
    want = P.recent_posts(spark.createDataFrame(rows, SCHEMA), n=5, tiebreak="id")
    assert sorted(map(tuple, state.texts().collect())) == sorted(map(tuple, want.collect()))
    sizes = {r["author"]: r["count"] for r in state.posts().groupBy("author").count().collect()}
    assert max(sizes.values()) == 5 and len(state.versions()) == 2


def test_replayed_batch_changes_nothing(spark, tmp_path):
    rows = log(60)
    state = SP.RecentPostsState(spark, str(tmp_path / "state"), n=3, tiebreak="id")
    for b in range(3):
        state.merge(spark.createDataFrame(rows[b::3], SCHEMA), b)
    before = sorted(map(tuple, state.texts().collect()))
    state.merge(spark.createDataFrame(rows[2::3], SCHEMA), 2)
    assert sorted(map(tuple, state.texts().collect())) == before
    # a write that was not committed doesn't count
    os.remove(tmp_path / "state" / "v2" / "_SUCCESS")
    assert state.versions() == [1]
    state.merge(spark.createDataFrame(rows[2::3], SCHEMA), 2)
    assert sorted(map(tuple, state.texts().collect())) == before


def test_state_without_batches(spark, tmp_path):
    state = SP.RecentPostsState(spark, str(tmp_path / "none"))
    assert state.versions() == [] and state.posts() is None
    with pytest.raises(ValueError):
        state.texts()


def test_cache_knows_its_input(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "cache")
    spark.createDataFrame([("a", "x", 1, 1), ("a", "y", 2, 2)], SCHEMA).write.parquet(src)

    def texts(n):
        return [r.text for r in P.recent_posts_versioned(spark, spark.read.parquet(src), root, n=n, tiebreak="id").collect()]
    assert texts(1) == ["y"] and texts(2) == ["x ||| y"]
    entries = len(os.listdir(tmp_path / "cache" / "data"))
    assert texts(1) == ["y"] and len(os.listdir(tmp_path / "cache" / "data")) == entries == 2
    spark.createDataFrame([("a", "z", 3, 3)], SCHEMA).write.mode("append").parquet(src)
    assert texts(1) == ["z"]


def test_interrupted_write_is_never_read(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "cache")
    spark.createDataFrame([("a", "x", 1, 1)], SCHEMA).write.parquet(src)
    df = spark.read.parquet(src)
    with pytest.raises(ZeroDivisionError):
        CA.cached(spark, root, {"p": df}, {"n": 1}, lambda: 1 / 0)
    key = CA.cache_key({"p": df}, {"n": 1})
    df.write.parquet(f"{root}/data/{key}-half")  # a folder without a manifest
    assert CA.published(spark, root, key) is None
    assert CA.cached(spark, root, {"p": df}, {"n": 1}, lambda: df.select("body")).columns == ["body"]
    # the first writer's manifest holds
    first = CA.published(spark, root, key)
    assert CA._publish(spark, root, key, "elsewhere") == first
    with pytest.raises(ValueError):
        CA.files_fingerprint(spark.range(3))
    shutil.rmtree(tmp_path / "cache" / "draft", ignore_errors=True)
