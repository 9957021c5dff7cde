import numpy as np

from textprofile.llm import quality as Q
from textprofile.llm import queries
from tests.conftest import SF_MID

from .frames import LONG, awkward, empty, labels


def test_features_by_hand():
    """As many features as n-grams and words; equal words have equal features."""
    def count(text):
        words = [f"<{w}>" for w in text.lower().split()]
        grams = sum(max(0, len(w) - n + 1) for w in words for n in range(Q.MIN_N, Q.MAX_N + 1))
        return grams + len(words) + sum(a == b for a, b in zip(words, words[1:]))

    for text in ("", "a", "ab abc  ABCD\nnonsense Ünïcode \U0001f600", "go go go", LONG):
        assert len(Q.features(text)) == count(text)
    one, two = Q.features("straße"), Q.features("straße straße")
    assert len(set(two.tolist()) - set(one.tolist())) == 1  # only the repetition is new
    assert len(Q.features(None)) == 0


def test_folded_scores_equal_the_network():
    rng = np.random.default_rng(1)
    m = Q.Model()
    m.layer, m.bias = rng.normal(size=(Q.DIM, 2)), rng.normal(size=2)
    for text in ("some words here", "x", ""):
        f = Q.features(text)
        z = (m.vectors[f].mean(axis=0) if len(f) else np.zeros(Q.DIM)) @ m.layer + m.bias
        p = np.exp(z[1]) / np.exp(z).sum()
        assert abs(Q.score_text(text, *m.folded()) - p) < 1e-6


def test_learns_subwords():
    good = [f"the river{i}ing flow{i}ing calmly" for i in range(60)]
    bad = [f"click{i}$$$ buy{i}$$$ now" for i in range(60)]
    m = Q.Model().fit([*good, *bad], [1] * 60 + [0] * 60, epochs=5, rate=0.3)
    score = lambda t: Q.score_text(t, *m.folded())
    assert score("the mountain999ing calmly") > 0.7 > 0.5 > score("sell999$$$ now")


def test_held_out_rows(spark):
    out = queries.op4_quality(spark, SF_MID)
    y = spark.read.parquet(f"{SF_MID}/labels.parquet").select("doc_id", "quality")
    rows = out.join(y, "doc_id").filter("held_out").collect()
    assert len(rows) > 60 and out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_awkward_rows(spark):
    df = awkward(spark)
    for lab in (labels(spark, [(i, int(i < 6), 0) for i in range(1, 10)] + [(None, 1, 1), (3, None, 0)]), labels(spark)):
        m = Q.fit(df, lab)
        out = Q.score(df, m).collect()
        assert len(out) == df.count() and all(0 <= r["score"] <= 1 for r in out)
        assert len({r["score"] for r in out if r["doc_id"] == 7}) == 1
        assert Q.score(empty(spark), m).count() == 0
    Q.fit(empty(spark), labels(spark))
