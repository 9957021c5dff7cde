from collections import Counter

import corpus_pipeline as C
from textprofile.llm import decontam, mixing, simhash, toxicity
from textprofile.llm.common import load, materialize
from textprofile.llm.queries import SHARDS, SIMHASH_RADIUS, SIMHASH_SHINGLE
from textprofile.llm.sharding import fill_table, table_size_for
from tests.conftest import SF_MID, SF_SMALL

from .frames import awkward
from .test_decontam import substring_distance
from .test_simhash import brute

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark):
    docs = load(spark, SF_SMALL, "documents")
    stage = dict(C.STAGES)
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    out = materialize(stage["toxicity"](spark, docs, SF_SMALL), "t1")
    index = toxicity.fit(docs, load(spark, SF_SMALL, "labels"))
    scorer = toxicity.Scorer(index)
    assert rows(out) == {i: t for i, t in rows(docs).items() if scorer(t)[0] < 0.5} and out.columns == DOC_COLUMNS

    before, out = out, materialize(stage["near_duplicates"](spark, out, SF_SMALL), "t2")
    items = sorted(rows(before).items())
    assert rows(out) == {i: t for (i, t), (_, _, c) in zip(items, brute(items)) if i == c} and out.columns == DOC_COLUMNS

    before, out = out, materialize(stage["decontamination"](spark, out, SF_SMALL), "t3")
    bench = [decontam.words_of(r["text"]) for r in load(spark, SF_SMALL, "benchmark").collect()]
    holds = lambda t: any(substring_distance(w, decontam.words_of(t)) <= decontam.max_edits(len(w), 0.8) for w in bench)
    short = {i: t for i, t in rows(before).items() if len(t) < 3000}  # brute force is slow on long texts
    assert {i for i in rows(out) if i in short} == {i for i, t in short.items() if not holds(t)} and out.columns == DOC_COLUMNS

    before, out = out, materialize(stage["mixing"](spark, out, SF_SMALL), "t4")
    plan = mixing.plan_mix(before).collect()
    size = {r["doc_id"]: r["size"] for r in plan}
    got = Counter(r["doc_id"] for r in out.collect())
    assert all(got[r["doc_id"]] * size[r["doc_id"]] == r["taken"] for r in plan) and out.columns == DOC_COLUMNS

    before, out = out, stage["sharding"](spark, out, SF_SMALL)
    assert out.columns == [*DOC_COLUMNS, "shard"] and out.count() == before.count()
    assert {r["shard"] for r in out.collect()} <= set(range(len(SHARDS)))


def test_run_equals_the_stages(spark):
    docs = load(spark, SF_SMALL, "documents")
    for _, f in C.STAGES:
        docs = materialize(f(spark, docs, SF_SMALL), "s")
    key = lambda r: (r["doc_id"], r["shard"])
    assert Counter(map(key, docs.collect())) == Counter(map(key, C.run(spark, SF_SMALL).collect()))


def test_awkward_rows(spark):
    for name, stage in C.STAGES:
        for docs in (awkward(spark), awkward(spark).limit(0)):
            out = stage(spark, docs, SF_SMALL)
            n = out.count()
            assert n > 0 or not docs.count(), name
            assert set(docs.columns) <= set(out.columns)


def test_queries_match_their_sql(spark):
    from tools.check import compare, duck

    from textprofile.llm import queries as Q

    con = duck(SF_MID)
    for name, sql in Q.ORACLE.items():
        assert compare(spark, name, Q.QUERIES[name], sql, SF_MID, con)["status"] == "ok", name


def test_parameters():
    assert (SIMHASH_SHINGLE, SIMHASH_RADIUS) == (3, 2) and simhash.SMALL > 1
    assert len(fill_table(SHARDS, table_size_for(len(SHARDS)))) == table_size_for(len(SHARDS))
