import random

import numpy as np
from pyspark.sql import functions as F

from textprofile.llm import queries
from textprofile.llm import toxicity as T
from tests.conftest import SF_MID, SF_SMALL

from .frames import awkward, empty, labels

TERMS = [f"t{i}".encode() for i in range(25)]


def _index(rng, n=600):
    space = T.Space(TERMS, [rng.randrange(1, 400) for _ in TERMS], 1000)
    text = lambda: " ".join(f"t{min(int(rng.expovariate(0.2)), 24)}" for _ in range(rng.randrange(0, 7)))
    return T.Index(space, [(i, space.counts(text()), rng.randrange(2)) for i in range(n)], k=9), space, text


def test_block_max_search_is_exact():
    rng = random.Random(3)
    index, space, text = _index(rng)
    dense = np.zeros((len(index.n), len(TERMS)))
    for t, (_, _, _, ords, ws) in index.postings.items():
        dense[ords, t] = ws
    index.visited, asked = 0, 0
    for _ in range(150):
        t, w = space.vector(space.counts(text() + " t3"))
        q = np.zeros(len(TERMS))
        q[t] = w
        sims = dense @ q
        order = np.argsort(-sims, kind="stable")
        total = np.cumsum(index.n[order])
        least = sims[order][min(np.searchsorted(total, index.k), len(order) - 1)]
        want = {i for i in range(len(sims)) if sims[i] >= least - 1e-12 and sims[i] > 0}
        ids, got = index.nearest(t, w)
        assert set(ids.tolist()) == want
        assert np.allclose(sims[ids], got)
        asked += 1
    assert index.visited < asked * index.blocks  # blocks were skipped


def test_calibrated_votes():
    """Examples with a marking word are label 1 nine times in ten: so score the votes."""
    rng = random.Random(8)
    space = T.Space(TERMS, [40] * len(TERMS), 1000)
    examples = []
    for i in range(2000):
        marked = rng.random() < 0.3
        c = space.counts(f"t{rng.randrange(5)}" if marked else "plain")
        examples.append((i, c, int(marked and rng.random() < 0.9)))
    index = T.Index(space, examples)
    assert abs(index.score(space.counts("t2"))[0] - 0.9) < 0.05
    assert index.score(())[0] < 0.01
    p, said = index.score(space.counts("t1 t2"))
    assert 0 < p < 1 and len(said.split(",")) == 3


def test_held_out_rows(spark):
    out = queries.op2_toxicity(spark, SF_MID)
    y = spark.read.parquet(f"{SF_MID}/labels.parquet").select("doc_id", "toxic")
    rows = out.join(y, "doc_id").filter("held_out").collect()
    assert len(rows) > 40 and out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_awkward_rows(spark):
    df = awkward(spark)
    taught = labels(spark, [(i, 1, int(i == 8)) for i in range(1, 10)] + [(None, 1, 1), (8, 1, None)])
    for lab in (taught, labels(spark)):
        index = T.fit(df, lab)
        out = T.score(df, index).collect()
        assert len(out) == df.count() and all(0 <= r["score"] <= 1 for r in out)
        assert T.drop_toxic(df, index, threshold=2.0).columns == df.columns
        assert T.drop_toxic(df, index, threshold=2.0).count() == df.count()
        assert T.drop_toxic(df, index, threshold=0.0).count() == 0
        assert T.score(empty(spark), index).count() == 0
    T.fit(empty(spark), labels(spark))


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    df = spark.range(400).selectExpr("id as doc_id", "concat(if(id % 4 = 0, 'some vile words ', 'some plain words '), id) as text")
    y = df.selectExpr("doc_id", "1 as quality", "cast(doc_id % 4 = 0 as int) as toxic")
    held = {r["doc_id"] for r in df.filter(queries.in_fold(F.col("doc_id"), 5, 0)).collect()}
    index = T.fit(df, y.filter(~queries.in_fold(F.col("doc_id"), 5, 0)))
    assert set(index.space.at) == {b"vile"}
    assert {i for e in index.examples for i, _ in e} == {i for i in range(0, 400, 4) if i not in held}
    rows = T.score(df, index).collect()
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in rows)
    assert all(int(x.split(":")[0]) not in held for r in rows for x in r["evidence"].split(",") if x)


def test_few_labelled_rows_are_enough(spark):
    """On 11 toxic and 75 clean texts there are terms, toxic rows are found and
    the pipeline's stage drops them."""
    import corpus_pipeline as C

    docs, y = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    index = T.fit(docs, y)
    assert {b"loser", b"moron", b"scum"} <= set(index.space.at)
    rows = T.score(docs, index).join(y, "doc_id").collect()
    assert sum(r["predicted"] for r in rows if r["toxic"]) >= 5 and not any(r["predicted"] for r in rows if not r["toxic"])
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in C.toxic(spark, docs, SF_SMALL).collect()}
    assert {r["doc_id"] for r in rows if r["predicted"]} <= gone
    out = queries.op2_toxicity(spark, SF_SMALL).join(y, "doc_id").filter("held_out").collect()
    assert [r["predicted"] for r in out] == [r["toxic"] for r in out]


def test_marking_counts_at_any_sample_size():
    """The same shares mark in any sample that can show them; chance doesn't."""
    for n in (30, 300, 3000):
        words = {(n // 10 * 4, 0): 3, (1, 0): 5 * n, (0, 1): 50 * n, (n // 10, n): 100}
        assert T.marking_counts(words, n, 9 * n) == {(n // 10 * 4, 0)}
    assert T.marking_counts({(1, 0): 40, (0, 1): 400}, 1, 10) == set()
    assert T.marking_counts({}, 0, 0) == set()
