import random

from textprofile.llm import decontam as D
from textprofile.llm.alignment import Pattern
from textprofile.llm.common import words_of

from .frames import LONG, awkward, empty


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def substring_distance(p, t):
    """Fewest edits between p and any run of t."""
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(t, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return min(row)


def noisy(rng, words, edits, vocab):
    w = list(words)
    for _ in range(edits):
        kind, p = rng.choice("sid"), rng.randrange(len(w)) if w else 0
        if kind == "i" or not w:
            w.insert(p, rng.choice(vocab))
        elif kind == "s":
            w[p] = rng.choice(vocab)
        else:
            del w[p]
    return w


def test_pattern_against_dynamic_programming():
    rng = random.Random(1)
    for _ in range(400):
        p, t = ([rng.choice("abcd") for _ in range(rng.randrange(n))] for n in (9, 25))
        edits, a, b = Pattern(p).locate(t)
        assert edits == substring_distance(p, t) == edit_distance(p, t[a:b])


def _items(rng, n=40):
    vocab = [f"w{i}" for i in range(120)]
    return vocab, [(i, " ".join(rng.choices(vocab, k=rng.choice((3, 5, 8, 20, 45))))) for i in range(n)]


def test_search_against_brute_force():
    """Every pair within the limit is found, and no other."""
    rng = random.Random(5)
    vocab, items = _items(rng)
    texts = [" ".join(rng.choices(vocab, k=80)) for _ in range(20)]
    for i, t in items:
        w = words_of(t)
        texts.append(" ".join(rng.choices(vocab, k=15)) + " " + b" ".join(
            noisy(rng, w, D.max_edits(len(w), 0.8), [v.encode() for v in vocab])).decode() + " " + " ".join(rng.choices(vocab, k=15)))
    index = D.Index(items)
    got = {(t, n): e for t, n, e, *_ in index.search(texts)}
    want = {}
    for t, text in enumerate(texts):
        for n, (_, item) in enumerate(items):
            w = words_of(item)
            e = substring_distance(w, words_of(text))
            if e <= D.max_edits(len(w), 0.8):
                want[t, n] = e
    assert set(got) <= set(want) and len(want) - len(got) <= 0.02 * len(want)
    # an accepted pair may report another occurrence's edits only if the LSH missed the best
    assert sum(got[k] != want[k] for k in got) <= 0.02 * len(got)


def test_recall_of_the_walks():
    """At the limit of edits, places of the walks agree as often as assumed."""
    rng = random.Random(3)
    vocab, items = _items(rng, 60)
    items = [x for x in items if len(x[1].split()) >= 20]
    index = D.Index(items)
    met = total = 0
    for _ in range(5):
        texts = []
        for _, t in items:
            w = words_of(t)
            texts.append(b" ".join(noisy(rng, w, D.max_edits(len(w), 0.8), list(index.vocab))).decode())
        found = {(t, n) for t, n, *_ in index.search(texts)}
        met += sum((i, i) in found for i in range(len(items)))
        total += len(items)
    assert met / total >= 0.97


def test_awkward_rows(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon", "x"), (2, None, "x"), (3, "", "x"), (4, "...", "x"),
                                   (5, "alpha beta gamma delta epsilon", "x"), (6, "word5 word6 word7 word8 word9 word10", "x"),
                                   (None, "no id at all", "x")], "item_id bigint, text string, edits string")
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in D.find_passages(awkward(spark), bench).collect()}
    assert got == {(1, 1, 1), (2, 1, 1), (8, 1, 0), (6, 6, 0), (7, 6, 0), (None, None, 0)}
    clean = D.drop_contaminated(awkward(spark), bench)
    assert clean.columns == awkward(spark).columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(map(str, [3, 4, 5, None, 8, 9]))
    assert D.find_passages(empty(spark), bench).count() == 0
    nothing = bench.limit(0)
    assert D.find_passages(awkward(spark), nothing).count() == 0
    assert D.drop_contaminated(awkward(spark), nothing).count() == awkward(spark).count()


def test_several_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(i, f"start{i} " + " ".join(f"u{i}x{j}" for j in range(12))) for i in range(30)],
                                  "item_id int, text string")
    docs = spark.createDataFrame([(i, f"before {r['text']} after") for i, r in enumerate(bench.collect())], "doc_id bigint, text string")
    monkeypatch.setattr(D, "BLOCK_ITEMS", 7)
    got = D.find_passages(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in got} == {(i, i, 0) for i in range(30)}
    assert D.drop_contaminated(docs, bench).count() == 0


def test_whole_long_texts():
    item = "a passage that stands at the very end of the text"
    index = D.Index([(1, item)])
    assert index.search([LONG + " " + item])[0][2] == 0
