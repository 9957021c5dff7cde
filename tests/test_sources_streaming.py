from pyspark.sql import functions as F

from textprofile.session import scratch_path
from textprofile.sources import readers as RD
from textprofile.sources import writers as WR


def test_trait_csv_roundtrip_quotes_newlines(spark):
    df = spark.createDataFrame([("a1", 'He said "hi".\nSee http://x.y z', "y", "N", "y", "n", "Y"),
                                ("a2", "", "n", "n", "n", "n", "n")],
                               "`#AUTHID` string, TEXT string, a string, b string, c string, d string, e string")
    path = scratch_path(spark, "t_csv")
    WR.write_csv(df, path)
    got = {r.user: r for r in RD.read_trait_corpus(spark, path).collect()}
    assert got["a1"].text == 'He said "hi".\nSee http://x.y z'
    assert (got["a1"].EXT, got["a1"].NEU, got["a1"].AGR, got["a1"].CON, got["a1"].OPN) == (1, 0, 1, 0, 1)
    assert got["a2"].text == "" and got["a2"].token_len == 0


def test_arff_reader(spark):
    path = scratch_path(spark, "t_arff")
    attrs = [("filename", "string")] + [(f"f{i}", "numeric") for i in range(9)]
    rows = spark.createDataFrame([("'x\\\\id_12',1,2,3,?,5,6,7,8,9",), ("short,row",), ("'y\\\\id_3',1,1,1,1,1,1,1,1,1",)],
                                 "value string")
    WR.write_arff(spark, rows, path, "r", attrs)
    out = RD.read_arff(spark, path, sort=True).collect()
    assert [r.idx for r in out] == [3, 12]
    assert out[1].f3 is None and out[1].f0 == 1.0 and out[1].f8 == 9.0


def test_stream_equals_batch(spark):
    from tests.conftest import SF_SMALL
    from textprofile.plans import q_model, q_text
    a = {tuple(r) for r in q_text.q_lexicon_vad(spark, SF_SMALL).collect()}
    b = {tuple(r) for r in q_model.q_stream_lexicon(spark, SF_SMALL).collect()}
    assert a == b and len(a) == 200


def test_embedding_store_pruning(spark):
    from tests.conftest import SF_SMALL
    from textprofile.plans import q_vec
    df = q_vec.q_embedding_store(spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "layer" in plan
    assert df.count() == 500 * 16


def test_count_list_formats(spark):
    single = scratch_path(spark, "t_counts_single")
    spark.createDataFrame([("[1, 2, 3, 4]",)], "value string").coalesce(1).write.text(single)
    got = sorted((r.doc_pos, r.n_chunks) for r in RD.read_count_list(spark, single, fmt="single").collect())
    assert got == [(0, 1), (1, 2), (2, 3), (3, 4)]
    lines = scratch_path(spark, "t_counts_lines")
    spark.createDataFrame([("0\t[1, 2]",), ("2\t[3, 4]",)], "value string").write.text(lines)
    got = sorted((r.doc_pos, r.n_chunks) for r in RD.read_count_list(spark, lines).collect())
    assert got == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_headerless_concept_vectors(spark):
    path = scratch_path(spark, "t_cv")
    WR.write_csv(spark.createDataFrame([("joy", 1.0, -2.0), ("fear", 0.5, 3.0)], "c string, a double, b double"),
                 path, header=False)
    got = {r.concept: r.vec for r in RD.read_concept_vectors(spark, path).collect()}
    assert got == {"joy": [1.0, -2.0], "fear": [0.5, 3.0]}
