from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textprofile.operators import chunk as C


def _docs(spark, n_tokens):
    toks = [f"t{i}" for i in range(n_tokens)]
    return spark.createDataFrame([(1, toks)], "doc_id long, toks array<string>")


def test_chunk_fixed_tail_cut(spark):
    rows = C.chunk_fixed(_docs(spark, 2100), "toks", size=512, max_chunks=4).orderBy("chunk_no").collect()
    assert [len(r.chunk) for r in rows] == [512] * 4
    assert rows[1].chunk[0] == "t512"


def test_chunk_overlap_windows(spark):
    rows = C.chunk_overlap(_docs(spark, 600), "toks", size=512, overlap=256).orderBy("chunk_no").collect()
    assert [(r.chunk[0], r.chunk[-1], len(r.chunk)) for r in rows] == [("t0", "t511", 512), ("t256", "t599", 344)]
    assert C.chunk_overlap(_docs(spark, 0), "toks", size=512, overlap=256).count() == 0


def _loop_windows(n, size, overlap):
    start, out = 0, []
    while start < n:
        end = min(start + size, n)
        out.append((start, end))
        if end == n:
            break
        start = end - overlap
    return out


@settings(max_examples=25, deadline=None)
@given(n=st.integers(0, 300), size=st.sampled_from([5, 16, 64]), overlap=st.integers(0, 4))
def test_overlap_equals_loop(spark, n, size, overlap):
    rows = C.chunk_overlap(_docs(spark, n), "toks", size=size, overlap=overlap).orderBy("chunk_no").collect()
    got = [(int(r.chunk[0][1:]), int(r.chunk[-1][1:]) + 1) for r in rows]
    assert got == _loop_windows(n, size, overlap)


@settings(max_examples=20, deadline=None)
@given(n=st.integers(0, 400), size=st.sampled_from([3, 10, 64]))
def test_fixed_chunks_reassemble(spark, n, size):
    rows = C.chunk_fixed(_docs(spark, n), "toks", size=size, max_chunks=10 ** 6).orderBy("chunk_no").collect()
    flat = [t for r in rows for t in r.chunk]
    assert flat == [f"t{i}" for i in range(n)]


def test_truncation_and_padding(spark):
    df = _docs(spark, 10)
    r = df.select(C.truncate_head("toks", 6).alias("h"), C.truncate_tail("toks", 6).alias("t"),
                  C.truncate_head_tail("toks", 2, 2).alias("ht")).first()
    assert r.h == ["t0", "t1", "t2", "t3"]
    assert r.t == ["t6", "t7", "t8", "t9"]
    assert r.ht == ["t0", "t1", "t8", "t9"]
    short = _docs(spark, 3).select(C.truncate_tail("toks", 6).alias("t"),
                                   C.truncate_head_tail("toks", 2, 2).alias("ht")).first()
    assert short.t == ["t0", "t1", "t2"] and short.ht == ["t0", "t1", "t2"]
    p = spark.createDataFrame([([1, 2],)], "a array<bigint>").select(C.pad_ids("a", 5).alias("p")).first().p
    assert p == [1, 2, 0, 0, 0]


def test_vocab_and_ids(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("b",), ("c",), ("a",), ("b",)], "word string")
    vocab = {r.word: (r.id, r.cnt) for r in C.build_vocab(rows).collect()}
    assert vocab == {"b": (4, 3), "a": (5, 2), "c": (6, 1)}
    docs = spark.createDataFrame([(1, ["a", "zz", "b"]), (2, [])], "doc_id long, toks array<string>")
    enc = {r.doc_id: r.ids for r in C.encode_ids(docs, "toks", C.build_vocab(rows), 6).collect()}
    assert enc[1] == [1, 5, 3, 4, 2, 0]
    assert enc[2] == [1, 2, 0, 0, 0, 0]


def test_id_lists_look_up_the_distinct_words_of_blocks(spark):
    words = ["the", "cat", "é", "mat", "zz", None]
    vocab = spark.createDataFrame([("the", 4), ("cat", 5), ("é", 9), ("mat", 1 << 40)], "word string, id long")
    ids = {"the": 4, "cat": 5, "é": 9, "mat": 1 << 40}
    rows = [(i, [words[(i * 7 + j * j) % 6] for j in range(n)]) for i, n in enumerate([0, 1, 3, 40, 2, 5, 0, 7])]
    rows += [(None, ["cat"]), (90, None), (91, []), (1, ["mat", "mat"])]
    df = spark.createDataFrame(rows, "k long, toks array<string>").repartition(5)
    want = sorted(((k is None, k or 0), [1, *[ids.get(w, 3) for w in t or []], 2]) for k, t in rows)
    for budget in (1, 6, 1000):
        blocks = C.word_blocks(df, "toks", "k", budget)
        got = C.block_id_lists(blocks, vocab, "k").collect()
        assert sorted(((r.k is None, r.k or 0), r.ids) for r in got) == want, budget
        counted = C.block_words(blocks).groupBy("word").agg(F.sum("n").alias("n"), F.count("n").alias("rows")).collect()
        flat = [w for _, t in rows for w in t or [] if w]
        assert {r.word: r.n for r in counted} == {w: flat.count(w) for w in flat}
        assert budget < 1000 or all(r.rows <= 5 for r in counted)  # a word once a block, not once a token
    assert sorted(((r.k is None, r.k or 0), r.ids) for r in C.word_id_lists(df, "toks", vocab, "k").collect()) == want


def test_blocks_of_texts_equal_blocks_of_tokens(spark):
    from textprofile.functions import text as T
    texts = ["a b  a", None, "", " \t ", "é　b\x1cA", "b " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").repartition(2)
    vocab = spark.createDataFrame([("a", 4), ("b", 5), ("é", 6)], "word string, id long")
    by_text = C.word_id_lists(df, "t", vocab, "k")
    by_tokens = C.word_id_lists(df.select("k", T.tokenize("t").alias("t")), "t", vocab, "k")
    assert sorted(map(tuple, by_text.collect())) == sorted(map(tuple, by_tokens.collect()))
    assert dict(by_text.collect())[4] == [1, 6, 5, 3, 2] and dict(by_text.collect())[1] == [1, 2]
    assert C.word_blocks(df.filter("k in (1, 2)"), "t", "k").count() == 2
    assert sorted(map(tuple, C.word_id_lists(df.filter("k in (1, 2)"), "t", vocab, "k").collect())) == [(1, [1, 2]), (2, [1, 2])]
