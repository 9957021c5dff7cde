import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textprofile.llm import mixing as M

from .frames import ROWS, awkward, empty


def levels(sizes, weights, total, epochs):
    """Targets by the words of the method: clamp, deal the excess again, repeat."""
    target = dict.fromkeys(sizes, 0.0)
    open_, left = set(sizes), float(total)
    while open_:
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w >= epochs * sizes[s]}
        if not over:
            for s in open_:
                target[s] = left * weights[s] / w
            break
        for s in over:
            target[s] = epochs * sizes[s]
        left -= sum(epochs * sizes[s] for s in over)
        open_ -= over
    return target


def test_water_fill(spark):
    sizes = {"a": 1000, "b": 10, "c": 300, "d": 0, "e": 50, "f": 700}
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sizes)}
    df = spark.createDataFrame([(s, weights[s], n) for s, n in sizes.items()], "source string, weight bigint, source_size bigint")
    for share in (0.1, 1.5, 1.9, 3.0):
        total = share * sum(sizes.values())
        got = {r["source"]: r["target"] for r in M.water_fill(df, total, 2).collect()}
        assert got == pytest.approx(levels(sizes, weights, total, 2))


def test_awkward_rows(spark):
    got = M.plan_mix(awkward(spark)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, size(t)) for i, t, _ in ROWS)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert M.plan_mix(empty(spark)).count() == 0
    again = M.plan_mix(awkward(spark).repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_taken_is_near_target_and_mix_takes_it(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "concat('s', cast(pmod(xxhash64(id), 7) % 5 as string)) as source",
                                      "trim(repeat('w ', cast(1 + pmod(xxhash64(id, 3), 40) as int))) as text")
    df = df.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "s0").otherwise(F.col("source")))
    plan = M.plan_mix(df).join(df.select("doc_id", "source"), "doc_id").collect()
    taken, target = defaultdict(int), {}
    for r in plan:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 20 for s in target)
    mixed = Counter(r["doc_id"] for r in M.mix(df).collect())
    assert mixed == Counter({r["doc_id"]: r["taken"] // r["size"] for r in plan if r["taken"]})


def test_mix_keeps_columns(spark):
    df = awkward(spark)
    out = M.mix(df)
    assert out.columns == df.columns and out.count() > 0
    assert M.mix(empty(spark)).count() == 0


def test_plan_reads_the_texts_once_and_holds_no_words(spark, tmp_path):
    docs = str(tmp_path / "docs")
    awkward(spark).write.parquet(docs)
    out = M.plan_mix(spark.read.parquet(docs))
    assert out.inputFiles() and not [f for f in out.inputFiles() if f"{docs}/" in f]
    sizes = spark.read.parquet(docs).select(M.n_words(F.col("text")))
    assert "regexp_extract_all" not in sizes._jdf.queryExecution().optimizedPlan().toString()


def test_n_words(spark):
    texts = ["", " ", "\t\n\x0b\x0c\r ", " a", "a ", "\n a\tb\x0b\x0cc\r\r", "\x1c\x1d \x85 z", "  q", "$1 \\ .", None,
             "\U0001F600 x\U0001F600"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", M.n_words(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [t if t is None else len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in (r.t for r in got)]
