import hashlib
import random
import re
from itertools import product

import numpy as np

from textprofile.llm import pii as P

from .frames import ROWS, awkward, empty

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def naive(s):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(s)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(s) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(s) if 12 <= len(digits(m)) <= 19 and P.luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(s) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def test_base_spans_against_the_plain_patterns():
    rng = random.Random(6)
    for alphabet in ("a1@.+- ()24Z", "0123456789 -", "12.5", "a@.%-", "+1 ()5é٣\n"):
        for _ in range(6000):
            s = "".join(rng.choice(alphabet) for _ in range(rng.randrange(45)))
            assert P.base_spans(s) == naive(s), s
    assert P.base_spans("x" * 40 + "é 1.2.3.0255 007.1.1.1 4111 1111 1111 1111") == naive("x" * 40 + "é 1.2.3.0255 007.1.1.1 4111 1111 1111 1111")


def test_luhn():
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")


def test_long_texts_take_linear_time():
    for s in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "a@" * 150_000, "@" * 300_000):
        P.annotate([s], P.Field())


def _field():
    f = P.Field()
    rng = np.random.default_rng(2)
    f.unary[:] = rng.normal(size=f.unary.shape) * 0.3
    f.chain[:], s = rng.normal(size=f.chain.shape), rng.normal(size=f.skip.shape)
    f.skip[:] = s + s.T
    return f


def test_messages_are_exact_on_trees():
    f = _field()
    b = P.Batch([P.graph_of("x 1a 2b 3c y 55551 z q 55551", [])])
    assert len(b.chain) == 2 and len(b.skip) == 1
    u = f.local(b)
    want = np.zeros_like(u)
    for y in product(range(P.LABELS), repeat=b.n):
        s = sum(u[i, k] for i, k in enumerate(y)) + sum(f.chain[y[i], y[j]] for i, j in b.chain) + sum(f.skip[y[i], y[j]] for i, j in b.skip)
        for i, k in enumerate(y):
            want[i, k] += np.exp(s)
    want /= want.sum(axis=1, keepdims=True)
    assert np.allclose(f.marginals(b, rounds=60), want, atol=1e-6)


def test_graph_links():
    text = "call +1 (876) 555-4733 or 876-555-4733 and 5554733 mail bob77.x@y.org bob77x 7 7"
    base = P.base_spans(text)
    g = P.graph_of(text, base)
    words = [text[a:b] for a, b in g.spans]
    assert words == ["+1", "(876)", "555-4733", "876-555-4733", "5554733", "bob77.x@y.org", "bob77x", "7", "7"]
    assert [(words[a], words[b]) for a, b in g.skip] == [("555-4733", "5554733"), ("bob77.x@y.org", "bob77x")]
    assert g.labels == [4, 4, 4, 0, 0, 1, 0, 0, 0]
    assert P.graph_of("nothing here", []) is None


def test_repeated_mentions_take_the_label():
    rng = random.Random(5)
    texts = []
    for _ in range(300):
        n = f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        texts.append(f"word {rng.choice(['ten', '10', '2021', 'v2'])} call +1 {n} or mail a{rng.randrange(99)}@x.org in {rng.randrange(1990, 2030)} for {rng.randrange(50)} items")
    field = P.Field().fit(P.Batch([P.graph_of(t, P.base_spans(t)) for t in texts]))
    text = "call +1 (876) 555-4733 soon , in 2020 or later (876) 555-4733 for 12 items"
    (base, added), = P.annotate([text], field)
    assert P.told(base) == "phone:5:22"
    assert [text[a:b] for a, k, b in added if k == 3] == ["(876) 555-4733"]
    assert all(text[a:b] not in ("2020", "12") for a, _, b in added)
    (_, none), = P.annotate(["it was 2020 and 12 items"], field)
    assert none == []


def test_awkward_rows(spark):
    df = awkward(spark)
    field = P.fit(df)
    out = P.find_personal_data(df, field).collect()
    assert len(out) == len(ROWS)
    assert all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() and r["n_email"] == 0 for r in out if not r["spans"])
    assert P.find_personal_data(empty(spark), P.fit(empty(spark))).count() == 0


def test_columns_follow_the_spans(spark):
    rows = [(1, "x a.b@c.de, 10.0.0.1 4111 1111 1111 1111 +1 (555) 123-4567 x"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r["doc_id"]: r for r in P.find_personal_data(df, P.Field()).collect()}
    want = P.told(naive(rows[0][1]))
    assert (out[1]["n_email"], out[1]["n_ip"], out[1]["n_phone"]) == tuple(sum(k == i for _, k, _ in naive(rows[0][1])) for i in (0, 1, 3))
    assert out[1]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and set(want.split(",")) <= set(out[1]["spans"].split(","))
    assert out[2]["spans"] == ""
