import hashlib
import random

import numpy as np
import pytest

from textprofile.llm import suffix_dedup as sd

from . import frames


@pytest.fixture(autouse=True)
def without_pauses(monkeypatch):
    monkeypatch.setattr(sd, "_free", lambda df: None)


def brute(rows, threshold):
    """rows in document order: for each the kept bytes and the number of removed runs."""
    seen, out = set(), []
    for text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - threshold + 1):
            s = raw[i:i + threshold]
            if s in seen:
                gone[i:i + threshold] = b"\1" * threshold
            seen.add(s)
        runs = sum(1 for i, x in enumerate(gone) if x and (not i or not gone[i - 1]))
        out.append((bytes(c for c, x in zip(raw, gone) if not x), len(raw), sum(gone), runs))
    return [(n, g, r, hashlib.sha256(k).hexdigest()) for k, n, g, r in out]


def texts(seed, n, letters="ab"):
    r = random.Random(seed)
    shared = ["".join(r.choice("abc") for _ in range(r.randint(5, 40))) for _ in range(4)]
    out = []
    for _ in range(n):
        parts = [r.choice(shared) if r.random() < 0.5 else "".join(r.choice(letters) for _ in range(r.randint(0, 30)))
                 for _ in range(r.randint(0, 6))]
        out.append("".join(parts))
    return out + [out[0], out[-1], None, "é" * 9, "é" * 9 + "x"]


@pytest.mark.parametrize("seed,threshold,gram,start", [(1, 8, 5, 2), (2, 12, None, None), (3, 7, 7, 3), (4, 20, 1, 1), (5, 9, 4, 9)])
def test_equals_brute_force(spark, monkeypatch, seed, threshold, gram, start):
    monkeypatch.setattr(sd, "SEGMENT", 16)
    rows = texts(seed, 40, "abcdefgh" if seed % 2 else "ab")
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(5)
    got = sd.substring_dedup(df, threshold=threshold, gram=gram, start=start).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got}
    assert [got[i] for i in range(len(rows))] == brute(rows, threshold)


def test_hot_strings_in_many_ranges(spark):
    """One passage in every text, one character over and over, whole copies:
    equal pairs go on over several ranges."""
    r = random.Random(7)
    passage = "the passage that every text holds in its middle"
    rows = ["".join(r.choice("abcdefghijk") for _ in range(r.randint(5, 25))) + passage + "".join(
        r.choice("abcdefghijk") for _ in range(r.randint(5, 25))) for _ in range(60)]
    rows += ["z" * 300, "z" * 100, *[passage] * 30, "q" + "z" * 50]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.substring_dedup(df, threshold=16, start=4).collect()}
    assert [got[i] for i in range(len(rows))] == brute(rows, 16)


def test_given_documents(spark):
    """Production parameters on whole texts of sf0.001, against brute force."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in df.collect())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.substring_dedup(df).collect()}
    assert [got[i] for i, _ in rows] == brute([t for _, t in rows], 100)
    assert sum(g[1] for g in got.values()) > 0


def test_kept_bytes_and_spans(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, "xxabcdefyy"), (3, "abcdefghij")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in sd.substring_dedup(df, threshold=4, texts=True).collect()}
    assert (bytes(got[2].kept), got[2].starts, got[2].ends) == (b"xxyy", [2], [8])
    assert bytes(got[3].kept) == b"" and got[3].n_spans == 1 and bytes(got[1].kept) == b"abcdefghij"


def test_awkward_rows(spark):
    rows = frames.awkward(spark)
    got = sd.substring_dedup(rows).collect()
    assert len(got) == len(frames.ROWS)
    size = len(frames.LONG)
    longs = sorted((r.doc_id, r.n_removed == size) for r in got if r.n_bytes == size)
    assert longs == [(6, False), (7, True), (7, True)]
    # the text's own words repeat: what stays is its first period
    assert {r.n_removed for r in got if r.doc_id == 6} == {brute([frames.LONG], 100)[0][1]}
    assert all(r.n_removed == 0 for r in got if r.n_bytes < 100)
    assert sum(r.doc_id is None for r in got) == 3
    assert sd.substring_dedup(frames.empty(spark)).count() == 0


def test_rows_alike_in_id_and_text(spark):
    t = "a text of forty bytes that is repeated.."
    rows = [(1, t), (1, t), (1, t), (None, t), (None, t), (2, "short"), (2, "short"), (0, "x" + t)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed, r.n_spans) for r in sd.substring_dedup(df, threshold=20).collect())
    assert got == [(False, 0, 0, 0)] + [(False, 1, 40, 1)] * 3 + [(False, 2, 0, 0)] * 2 + [(True, 0, 40, 1)] * 2


def test_sampling_agrees_in_equal_windows():
    """Equal windows choose the same place, and every window is covered once."""
    r = random.Random(3)
    a = "".join(r.choice("abcd") for _ in range(400)).encode()
    data = np.frombuffer(a + b"--" + a[100:300], dtype=np.uint8)
    g, c, first, many = sd.sampled(data, 30, 12)
    assert np.array_equal(np.repeat(first - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum()), np.arange(len(data) - 29))


def test_lengths():
    assert sd.lengths_of(100, 25) == [25, 50, 100] and sd.lengths_of(7, 3) == [3, 6, 7] and sd.lengths_of(9, 9) == [9]
