import hashlib
from collections import Counter

from textprofile.llm import exact_dedup as E

from .frames import ROWS, awkward, empty


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t, *_ in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return Counter(out)


def test_awkward_rows(spark):
    assert Counter(map(tuple, E.exact_duplicates(awkward(spark)).collect())) == brute(ROWS)
    assert E.exact_duplicates(empty(spark)).count() == 0


def test_a_full_filter_is_still_right(spark, monkeypatch):
    """Far more rows than cells: all rows look repeated, none is lost."""
    rows = [(i, f"text {i // 2 if i % 5 else i}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(E, "BITMAP", 64)
    got = Counter(map(tuple, E.exact_duplicates(df, max_bits=64).collect()))
    assert got == brute(rows)


def test_most_unique_rows_pass_straight_through(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "sha2(cast(id as string), 256) as text_sha256")
    df = df.unionByName(df.filter("doc_id < 500").selectExpr("doc_id + 1000000 as doc_id", "text_sha256"))
    bits = E.filter_bits(df.count())
    flagged = E.flag_possible(df, E.repeated_cells(df, bits), bits)
    possible = flagged.filter("possible").count()
    assert flagged.count() == 20_500 and 1000 <= possible < 1000 + 0.05 * 20_000


def test_drop_keeps_all_columns(spark):
    df = awkward(spark)
    out = E.drop_exact_duplicates(df)
    assert out.columns == df.columns
    assert {r["doc_id"] for r in out.collect()} == {2, 5, 7, None, 8, 9, 4}


def test_filter_keeps_columns_of_any_name(spark):
    rows = awkward(spark)
    out = E.drop_exact_duplicates(rows)
    assert out.columns == rows.columns and out.filter("text like 'alpha%'").count() == 2
    assert E.drop_exact_duplicates(empty(spark)).count() == 0
