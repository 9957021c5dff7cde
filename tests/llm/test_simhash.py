import random
from collections import Counter
from itertools import combinations

import xxhash

from textprofile.llm import simhash as S
from textprofile.llm.components import components

from .frames import ROWS, awkward, empty


def fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    sh = [b" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(n, links):
    up = list(range(n))
    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def brute(rows):
    fps = [fingerprint(t) for _, t, *_ in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if bin(fps[i] ^ fps[j]).count("1") <= 2]
    root = roots(len(rows), links)
    least = {}
    for r, (i, *_) in zip(root, rows):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return [(i, f"{f:016x}", least[r]) for (i, *_), f, r in zip(rows, fps, root)]


def test_masks_cover_every_pair():
    for radius in (1, 2):
        masks = [m & (1 << 64) - 1 for m in S.covering_masks(radius)]
        assert len(masks) == 2 ** (radius + 1) - 1
        for bits in combinations(range(64), radius):
            diff = sum(1 << b for b in bits)
            assert any(not m & diff for m in masks)
        assert all(32 <= bin(m).count("1") <= 44 for m in masks)


def test_components_against_union_find(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(300, 360)]
    root = roots(400, links)
    df = spark.createDataFrame([*links, (7, 7), (None, 3)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {x: root[x] for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def _connected(spark, fps, radius):
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    pos = {f - (1 << 64) if f >> 63 else f: i for i, f in enumerate(fps)}
    got = [(pos[r["a"]], pos[r["b"]]) for r in S.fingerprint_links(df, radius).collect()]
    want = [(i, j) for i, j in combinations(range(len(fps)), 2) if bin(fps[i] ^ fps[j]).count("1") <= radius]
    assert roots(len(fps), got) == roots(len(fps), want)


def test_links_in_small_and_large_buckets(spark):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:40]:
        fps.add(f ^ 1 << rng.randrange(64))
    centre = rng.getrandbits(64)  # many around one: buckets beyond SMALL
    for _ in range(250):
        fps.add(centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(1, 6))}))
    for radius in (1, 2):
        _connected(spark, sorted(fps), radius)


def test_awkward_rows(spark):
    out = S.simhash_components(awkward(spark)).select("doc_id", "fingerprint", "component_id").collect()
    assert Counter(map(tuple, out)) == Counter(brute(ROWS))
    assert S.simhash_components(empty(spark)).count() == 0


def test_near_copies(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=300))) for i in range(30)]
    for i in range(30, 60):
        w = rows[i - 30][1].split()
        if i % 2:
            w[rng.randrange(300)] = "changed"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    out = S.simhash_components(df).select("doc_id", "fingerprint", "component_id").collect()
    assert Counter(map(tuple, out)) == Counter(brute(rows))


def test_one_row_of_each_group_stays(spark):
    df = awkward(spark)
    out = S.drop_near_duplicates(df)
    assert out.columns == df.columns
    got = Counter(r["doc_id"] for r in out.collect())
    # one for every component; id 8 holds two texts of different components
    fps = [fingerprint(t) for _, t, *_ in ROWS]
    root = roots(len(ROWS), [(i, j) for i, j in combinations(range(len(ROWS)), 2) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    least = {r: min((ROWS[i][0] for i in range(len(ROWS)) if root[i] == r and ROWS[i][0] is not None), default=None)
             for r in root}
    assert got == Counter(least.values())


def test_filter_keeps_columns_of_any_name(spark):
    rows = awkward(spark)
    out = S.drop_near_duplicates(rows)
    assert out.columns == rows.columns and out.count() < len(ROWS)
    assert S.drop_near_duplicates(empty(spark)).count() == 0
