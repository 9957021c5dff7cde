"""Registered queries, steps 4-5: vectors, pooling, layers, encoders, folds."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numeric import round_to
from ..operators import features as FE
from ..operators import folds as FO
from ..operators import lexicon as LX
from ..operators import vectors as V
from ..operators.rank import global_position
from ..session import scratch_path
from ..sources import readers as RD
from ..sources import writers as WR
from . import derived as D
from . import sqlfrag as S
from .tables import load

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c):
    return round_to(c, 6)


def long_vec(df, keys, vec="vec", pos="pos", value="value"):
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.select(*keys, F.posexplode(vec).alias(pos, "_x")).select(
        *keys, F.col(pos).cast("bigint").alias(pos), r6(F.col("_x").cast("double")).alias(value))


_SQL_EL = ("SELECT vec_id, label, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x "
           "FROM embeddings")


def _emb(spark, sf):
    return load(spark, sf, "embeddings")


# ---- pooling ----------------------------------------------------------------------

@register("pool_mean", f"WITH el AS ({_SQL_EL}) SELECT label::BIGINT AS label, pos::BIGINT AS pos, "
          "round(avg(x), 6) AS value FROM el GROUP BY label, pos")
def q_pool_mean(spark, sf):
    """Mean pooling of token vectors per document (document = label)."""
    pooled = V.pool_vectors(_emb(spark, sf), ["label"], "embedding", how="mean")
    return long_vec(pooled.withColumn("label", F.col("label").cast("bigint")), "label")


@register("pool_first", f"WITH el AS ({_SQL_EL}), f AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label) "
          "SELECT el.label::BIGINT AS label, el.pos::BIGINT AS pos, round(el.x, 6) AS value FROM el JOIN f "
          "ON el.vec_id = f.vec_id")
def q_pool_first(spark, sf):
    """First-token pooling: the vector with the smallest position."""
    pooled = V.pool_vectors(_emb(spark, sf), ["label"], "embedding", how="first", order="vec_id")
    return long_vec(pooled.withColumn("label", F.col("label").cast("bigint")), "label")


@register("pool_chunks", f"WITH el AS ({_SQL_EL}), c AS (SELECT label, vec_id % 4 AS chunk, pos, avg(x) AS m "
          "FROM el GROUP BY 1, 2, 3) SELECT label::BIGINT AS label, pos::BIGINT AS pos, round(avg(m), 6) AS value "
          "FROM c GROUP BY label, pos")
def q_pool_chunks(spark, sf):
    """Mean over a document's chunk means (chunk = vec_id mod 4)."""
    df = _emb(spark, sf).withColumn("chunk", F.col("vec_id") % 4)
    pooled = V.pool_two_level(df, ["label"], ["chunk"], "embedding")
    return long_vec(pooled.withColumn("label", F.col("label").cast("bigint")), "label")


WIN, WIN_OVERLAP = 8, 2


@register("pool_windows", D.with_ctes(
    p=f"SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS p, "
      "count(*) OVER (PARTITION BY label) AS n FROM embeddings",
    w=f"SELECT vec_id, label, unnest(range(greatest(0, ceil((p - {WIN - 1}) / {WIN - WIN_OVERLAP}))::BIGINT, "
      f"least(floor(p / {WIN - WIN_OVERLAP})::BIGINT, (CASE WHEN n <= {WIN} THEN 1 ELSE ceil((n - {WIN}) / {WIN - WIN_OVERLAP}) + 1 END)::BIGINT - 1) + 1)) AS win FROM p",
    el=_SQL_EL,
    m="SELECT w.label, w.win, el.pos, avg(el.x) AS m FROM w JOIN el ON w.vec_id = el.vec_id GROUP BY 1, 2, 3")
    + "SELECT label::BIGINT AS label, pos::BIGINT AS pos, round(avg(m), 6) AS value FROM m GROUP BY label, pos")
def q_pool_windows(spark, sf):
    """Mean over overlapping windows (8 vectors, overlap 2) of each document's
    vectors in position order."""
    df = V.window_memberships(_emb(spark, sf), "label", "vec_id", WIN, WIN_OVERLAP)
    pooled = V.pool_two_level(df, ["label"], ["win"], "embedding")
    return long_vec(pooled.withColumn("label", F.col("label").cast("bigint")), "label")


_RUN_IDX = "CASE p % 10 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 3 END"


@register("chunk_mean_by_counts", D.with_ctes(
    pe=f"SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS p FROM embeddings",
    runs=f"SELECT p AS start, 4 * (p // 10) + {_RUN_IDX} AS run, {_RUN_IDX} + 1 AS n FROM pe WHERE p % 10 IN (0, 1, 3, 6)",
    mem="SELECT runs.run, pe.vec_id FROM runs JOIN pe ON pe.p >= runs.start AND pe.p < runs.start + runs.n",
    el=_SQL_EL)
    + "SELECT mem.run::BIGINT AS run, el.pos::BIGINT AS pos, round(avg(el.x), 6) AS value FROM mem JOIN el "
      "ON mem.vec_id = el.vec_id GROUP BY mem.run, el.pos")
def q_chunk_mean_by_counts(spark, sf):
    """Flat vector list (vec_id order) consumed in runs of lengths 1, 2, 3, 4,
    1, 2, ... (the run-length list is derived from the vector positions,
    written as a count-list text file and read back)."""
    emb = _emb(spark, sf)
    pos = global_position(emb.select("vec_id"), ["vec_id"], name="p")
    m = F.col("p") % 10
    idx = F.when(m == 0, 0).when(m == 1, 1).when(m == 3, 2).otherwise(3)
    counts = pos.filter(m.isin(0, 1, 3, 6)).select(
        ((F.col("p") / 10).cast("long") * 4 + idx).alias("doc_pos"), (idx + 1).alias("n_chunks"))
    # the count list travels as a text file: lines "<first doc_pos>\t[c, c, ...]"
    path = scratch_path(spark, "count_list")
    lines = counts.groupBy((F.col("doc_pos") / 8).cast("long").alias("_g")).agg(
        F.array_sort(F.collect_list(F.struct("doc_pos", "n_chunks"))).alias("_l"))
    lines.select(F.concat(F.element_at("_l", 1)["doc_pos"].cast("string"), F.lit("\t"),
                          F.to_json(F.transform("_l", lambda s: s["n_chunks"]))).alias("value")) \
        .write.mode("overwrite").text(path)
    counts = RD.read_count_list(spark, path)
    out = V.chunk_mean_by_counts(emb, counts, "vec_id", "embedding")
    return long_vec(out.withColumnRenamed("doc_pos", "run"), "run")


# ---- layers -------------------------------------------------------------------------

N_LAYERS, LAYER_DIM = 4, 16
_SQL_LAYERS = (f"SELECT vec_id, pos // {LAYER_DIM} + 1 AS layer, pos % {LAYER_DIM} AS lpos, x FROM ({_SQL_EL})")


def _store(spark, sf):
    return V.layer_rows(_emb(spark, sf), "vec_id", "embedding", N_LAYERS, LAYER_DIM)


@register("layer_select", f"SELECT vec_id, lpos::BIGINT AS pos, round(x, 6) AS value FROM ({_SQL_LAYERS}) WHERE layer = 3")
def q_layer_select(spark, sf):
    return long_vec(V.layer_mix(_store(spark, sf), ["vec_id"], 3), "vec_id")


@register("layer_mix", f"SELECT vec_id, lpos::BIGINT AS pos, round(sum(x * 0.25), 6) AS value FROM ({_SQL_LAYERS}) "
          "GROUP BY vec_id, lpos")
def q_layer_mix(spark, sf):
    """Uniform mix over the four layers (``all``)."""
    return long_vec(V.layer_mix(_store(spark, sf), ["vec_id"], "all", n_layers=N_LAYERS), "vec_id")


_WEIGHTS = (0.1, 0.2, 0.3, 0.4)


@register("layer_mix_weighted", f"SELECT vec_id, lpos::BIGINT AS pos, round(sum(x * [{', '.join(map(str, _WEIGHTS))}][layer]), 6) "
          f"AS value FROM ({_SQL_LAYERS}) GROUP BY vec_id, lpos")
def q_layer_mix_weighted(spark, sf):
    return long_vec(V.layer_mix(_store(spark, sf), ["vec_id"], list(_WEIGHTS)), "vec_id")


@register("embedding_store", f"SELECT vec_id, lpos::BIGINT AS pos, round(x, 6) AS value FROM ({_SQL_LAYERS}) WHERE layer = 2")
def q_embedding_store(spark, sf):
    """Write the layer store partitioned by dataset/encoder/pool/mode (two
    modes), read back one partition and one layer (pruned + pushed down)."""
    root = scratch_path(spark, "store")
    st = _store(spark, sf).select(F.col("vec_id").alias("author_id"), F.lit(0).alias("chunk_no"), "layer", "vec")
    tagged = st.withColumn("dataset", F.lit("emb")).withColumn("encoder", F.lit("given")).withColumn("pool", F.lit("mean"))
    both = tagged.withColumn("mode", F.lit("head")).unionByName(
        tagged.withColumn("mode", F.lit("tail")).withColumn("vec", F.reverse("vec")))
    WR.write_embedding_store(both, root)
    back = WR.read_embeddings(spark, root, "emb", "given", "mean", "head", layer=2)
    return long_vec(back.withColumnRenamed("author_id", "vec_id"), "vec_id")


# ---- encoders ---------------------------------------------------------------------------

DIM = 64
_SQL_LTOK = f"SELECT doc_id, unnest({S.tokens('lower(text)')}) AS t FROM documents"
_SQL_HASH = D.with_ctes(
    lt=_SQL_LTOK,
    h=f"SELECT doc_id, {S.hexint('t', 1, 8)} AS h FROM lt",
    s=f"SELECT doc_id, h % {DIM} AS bucket, sum(CASE WHEN (h >> 6) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM h GROUP BY 1, 2",
    nrm="SELECT doc_id, sqrt(sum(v * v)) AS nv FROM s GROUP BY doc_id",
    dense=f"SELECT n.doc_id, b.bucket, coalesce(s.v / nullif(n.nv, 0), 0.0) AS value FROM nrm n "
          f"CROSS JOIN (SELECT unnest(range(0, {DIM})) AS bucket) b LEFT JOIN s ON s.doc_id = n.doc_id AND s.bucket = b.bucket")


def _lower_token_docs(spark, sf):
    docs = load(spark, sf, "documents")
    return docs.select("doc_id", T.tokenize_batches(F.lower(F.col("text"))).alias("toks"))


@register("embed_hashing", _SQL_HASH + "SELECT doc_id, bucket::BIGINT AS bucket, round(value, 6) AS value FROM dense")
def q_embed_hashing(spark, sf):
    """Default encoder: signed 64-bucket feature hashing, L2-normalised."""
    dense = V.hashing_embed_docs(_lower_token_docs(spark, sf), "doc_id", "toks", dim=DIM, batches=True)
    return long_vec(dense, "doc_id", pos="bucket")


@register("embed_plugin", _SQL_HASH + "SELECT doc_id, bucket::BIGINT AS bucket, round(value, 6) AS value FROM dense")
def q_embed_plugin(spark, sf):
    """Plug-in encoder slot: the same hashing encoder written in numpy, run
    over Arrow batches of 32 documents by ``mapInPandas``."""
    docs = load(spark, sf, "documents").select("doc_id", T.tokenize(F.lower(F.col("text"))).alias("toks"))
    return long_vec(V.embed(docs, "toks", "hashing64_numpy"), "doc_id", pos="bucket")


@register("combined_features", _SQL_HASH.replace("WITH ", "WITH bench_words AS (" + D.SQL_BENCH_WORDS + "), lex AS ("
                                                 + D.SQL_VAD_LEX + "), tok AS (SELECT doc_id, unnest(" + S.tokens("text")
                                                 + ") AS word FROM documents), ", 1)
          + ", vad AS (SELECT d.doc_id, a.valence, a.arousal, a.dominance FROM documents d LEFT JOIN (SELECT tok.doc_id, "
          + ", ".join(f"sum(lex.{x})::DOUBLE / count(*) AS {x}" for x in D.VAD)
          + " FROM tok JOIN lex ON tok.word = lex.word GROUP BY tok.doc_id) a ON d.doc_id = a.doc_id) "
          "SELECT d.doc_id, b.bucket::BIGINT AS idx, round(coalesce(dense.value, 0), 6) AS value FROM documents d "
          "CROSS JOIN (SELECT unnest(range(0, 64)) AS bucket) b LEFT JOIN dense ON dense.doc_id = d.doc_id AND dense.bucket = b.bucket "
          "UNION ALL SELECT vad.doc_id, 64 + k AS idx, round(coalesce([vad.valence, vad.arousal, vad.dominance][k + 1], 0), 6) "
          "FROM vad CROSS JOIN (SELECT unnest(range(0, 3))::BIGINT AS k) kk")
def q_combined_features(spark, sf):
    """Embedding vector joined with psycholinguistic scores by author and
    assembled into one feature vector (missing scores -> 0)."""
    dense = V.hashing_embed_docs(_lower_token_docs(spark, sf), "doc_id", "toks", dim=DIM, batches=True) \
        .withColumn("emb", array_to_vector(F.coalesce("vec", F.array(*[F.lit(0.0)] * DIM))))
    vad = LX.lexicon_features(load(spark, sf, "documents"), D.vad_lexicon(spark, sf), D.VAD)
    joined = FE.fill_missing(dense.join(vad, "doc_id"), list(D.VAD))
    vec = FE.assemble(joined, ["emb"] + list(D.VAD))
    return FE.vector_long(vec, "doc_id").select("doc_id", F.col("idx").cast("bigint").alias("idx"),
                                                  r6("value").alias("value"))


# ---- folds ----------------------------------------------------------------------------------

_SQL_LONG = ("SELECT doc_id, 'quality' AS trait, quality AS y FROM labels UNION ALL "
             "SELECT doc_id, 'toxic', toxic FROM labels")
_SQL_STRAT = D.with_ctes(
    lg=_SQL_LONG,
    c="SELECT trait, y, min(doc_id) AS first, count(*) AS n FROM lg GROUP BY trait, y",
    c2="SELECT trait, y, n, coalesce(sum(n) OVER (PARTITION BY trait ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM c",
    a="SELECT trait, y, f, greatest(0, ceil((n - (((f - o) % 10) + 10) % 10) / 10.0)) AS a FROM c2, (SELECT unnest(range(0, 10)) AS f) ff",
    ce="SELECT trait, y, f, sum(a) OVER (PARTITION BY trait, y ORDER BY f) AS cum FROM a",
    r="SELECT doc_id, trait, y, row_number() OVER (PARTITION BY trait, y ORDER BY doc_id) - 1 AS r FROM lg",
    folds="SELECT r.doc_id, r.trait, r.y, count(ce.f)::BIGINT AS fold FROM r LEFT JOIN ce ON ce.trait = r.trait AND ce.y = r.y "
          "AND ce.cum <= r.r GROUP BY r.doc_id, r.trait, r.y")


def _strat(spark, sf):
    lab = load(spark, sf, "labels")
    long = lab.unpivot(["doc_id"], ["quality", "toxic"], "trait", "y")
    return FO.stratified_folds(long, "y", "doc_id", k=10, by=["trait"])


@register("stratified_folds", _SQL_STRAT + "SELECT doc_id, trait, fold FROM folds")
def q_stratified_folds(spark, sf):
    """10-fold stratified, unshuffled, per trait, in doc_id order."""
    return _strat(spark, sf).select("doc_id", "trait", F.col("fold").cast("bigint").alias("fold"))


@register("fold_train_test_counts", _SQL_STRAT +
          "SELECT trait, fold, ((SELECT count(*) FROM labels) - count(*))::BIGINT AS n_train, count(*)::BIGINT AS n_test, "
          "sum(y)::BIGINT AS pos_test FROM folds GROUP BY trait, fold")
def q_fold_train_test_counts(spark, sf):
    out = FO.fold_counts(_strat(spark, sf), "y", 10, by=["trait"])
    return out.select("trait", F.col("fold").cast("bigint").alias("fold"), "n_train", "n_test", "pos_test")


def _sql_kfold(n_expr="(SELECT count(*) FROM labels)"):
    return D.with_ctes(
        p="SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id::VARCHAR), doc_id) - 1 AS p FROM labels",
        k=f"SELECT {n_expr} // 10 AS q, {n_expr} % 10 AS r")


@register("kfold_shuffled", _sql_kfold() + "SELECT doc_id, (CASE WHEN p < r * (q + 1) THEN p // (q + 1) "
          "ELSE r + (p - r * (q + 1)) // q END)::BIGINT AS fold FROM p, k")
def q_kfold_shuffled(spark, sf):
    """10-fold shuffled split, seed 0 (portable seeded order)."""
    out = FO.kfold_shuffled(load(spark, sf, "labels").select("doc_id"), "doc_id", k=10, seed=0)
    return out.select("doc_id", F.col("fold").cast("bigint").alias("fold"))


@register("holdout_split", D.with_ctes(
    p="SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id::VARCHAR), doc_id) - 1 AS p FROM labels",
    n="SELECT floor(count(*) * 0.8)::BIGINT AS ntr FROM labels")
    + "SELECT doc_id, CASE WHEN p >= ntr THEN 'test' WHEN p >= floor(ntr * 0.9) THEN 'val' ELSE 'train' END AS split FROM p, n")
def q_holdout_split(spark, sf):
    """80/20 split after the seeded shuffle; last 10 % of training rows = validation tail."""
    return FO.holdout_split(load(spark, sf, "labels").select("doc_id"), "doc_id", seed=0).select("doc_id", "split")
