import pytest
from pyspark.sql import functions as F

from textprofile.functions import text as T


def one(spark, expr, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_clean_text_links_and_whitespace(spark):
    assert one(spark, T.clean_text(F.col("s")), "a http://x.y  b") == "a b"


def test_clean_text_separator_after_collapse(spark):
    assert one(spark, T.clean_text(F.col("s"), social=False), "a ||| b") == "a   b"
    assert one(spark, T.clean_text(F.col("s")), "a ||| b") == "a   b"


def test_clean_strict_isolated_letters_non_overlapping(spark):
    assert one(spark, T.clean_strict(F.col("s"), social=False), "x a b c y") == "x b y"
    # I is kept
    assert one(spark, T.clean_strict(F.col("s"), social=False), "so I think") == "so I think"


def test_clean_strict_keeps_letters_and_punctuation(spark):
    assert one(spark, T.clean_strict(F.col("s"), social=False), "Hi, 42 there!") == "Hi, there!"


def test_clean_social(spark):
    out = one(spark, T.clean_social(F.col("s")), "RT @bob: see #tag :) 12 now \U0001F600 http://a.b/c")
    assert out == "see now"


def test_tokenize_python_whitespace(spark):
    toks = one(spark, T.tokenize(F.col("s")), " a b\tc　d\x1ce ")
    assert toks == " a b\tc　d\x1ce ".split()


def test_sentences(spark):
    assert one(spark, F.size(T.sentences(F.col("s"))), "One. Two? Three! four") == 4
    assert one(spark, F.size(T.sentences(F.col("s"))), "") == 0


def test_parse_bool(spark):
    df = spark.createDataFrame([(w,) for w in ["True", "f", "YES", "n", "1", "0"]], "s string")
    assert [r.b for r in df.select(T.parse_bool("s").alias("b")).collect()] == [True, False, True, False, True, False]
    with pytest.raises(Exception):
        spark.createDataFrame([("maybe",)], "s string").select(T.parse_bool("s")).collect()


def test_yes_no_and_code_letters(spark):
    df = spark.createDataFrame([("Y",), ("n",), (None,), ("yes",)], "s string")
    assert [r.f for r in df.select(T.yes_no_flag("s").alias("f")).collect()] == [1, 0, 0, 0]
    df = spark.createDataFrame([("ENFJ",), ("enfj",), ("IS",), (None,)], "s string")
    got = [tuple(r) for r in df.select(*[T.code_letter_flag("s", p, l) for l, p in
                                         (("E", 1), ("N", 2), ("F", 3), ("J", 4))]).collect()]
    assert got == [(1, 1, 1, 1), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)]


def test_normalize_author_id(spark):
    df = spark.createDataFrame([("'dir\\\\id_12'",), ("id_7",), ("'x\\\\idx_3'",)], "s string")
    assert [r.i for r in df.select(T.normalize_author_id("s").alias("i")).collect()] == [12, 7, None]


def test_strict_cast_raises_under_ansi(spark):
    from textprofile.plans.q_text import read_affect_lexicon
    from textprofile.plans import derived as D
    row = ("c",) + ("1",) * 4 + ("bad",) + ("x",) * len(D.AFFECT_DESCRIPTIVE)
    cols = ["concept", *D.AFFECT, *D.AFFECT_DESCRIPTIVE]
    df = spark.createDataFrame([row], cols)
    with pytest.raises(Exception):
        read_affect_lexicon(df).collect()
