"""Registered queries, steps 6-8: training, evaluation records, scoring,
attribution, streaming."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numeric import round_to, softmax
from ..operators import explain as X
from ..operators import features as FE
from ..operators import folds as FO
from ..operators import models as M
from ..operators import newton as NW
from ..operators import vectors as V
from ..session import scratch_path
from ..sources import writers as WR
from ..streaming import score as ST
from . import derived as D
from . import q_text
from .q_vec import _SQL_HASH, _SQL_STRAT
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


# ---- rule-based predictions over folds (oracle-checkable evaluation) ----------------

def _rule_folds(spark, sf):
    lab = load(spark, sf, "labels")
    long = lab.unpivot(["doc_id"], ["quality", "toxic"], "trait", "y")
    folded = FO.stratified_folds(long, "y", "doc_id", k=10, by=["trait"])
    pred = F.when(F.col("trait") == "quality", F.col("doc_id") % 2).otherwise((F.col("doc_id") % 3 == 0).cast("long"))
    return folded.withColumn("prediction", pred).withColumn("fold", F.col("fold") + 1)


_SQL_RULE_ACC = _SQL_STRAT + (
    ", acc AS (SELECT trait, fold + 1 AS fold, avg(CASE WHEN (CASE WHEN trait = 'quality' THEN doc_id % 2 "
    "ELSE (doc_id % 3 = 0)::BIGINT END) = y THEN 1 ELSE 0 END) AS acc FROM folds GROUP BY trait, fold) ")


def _accuracy(spark, sf):
    return M.accuracy(_rule_folds(spark, sf), ["trait", "fold"], label="y")


@register("accuracy_by_fold", _SQL_RULE_ACC + "SELECT trait, fold::BIGINT AS fold, round(acc, 6) AS acc FROM acc")
def q_accuracy_by_fold(spark, sf):
    """Held-out accuracy per trait and fold (1-based) of fixed predictions."""
    return _accuracy(spark, sf).select("trait", F.col("fold").cast("bigint").alias("fold"), r6("acc").alias("acc"))


@register("fold_report", _SQL_RULE_ACC + "SELECT trait, count(*)::BIGINT AS n_folds, round(avg(acc), 6) AS mean_acc, "
          "round(min(acc), 6) AS min_acc FROM acc GROUP BY trait")
def q_fold_report(spark, sf):
    """Per-trait report written as JSON (fold accuracies in order + mean) and read back."""
    path = scratch_path(spark, "fold_report")
    WR.write_fold_report(_accuracy(spark, sf), path)
    back = spark.read.json(path)
    return back.select("trait", F.size("folds").cast("bigint").alias("n_folds"), r6("mean_acc").alias("mean_acc"),
                       r6(F.array_min("folds")).alias("min_acc"))


@register("best_model_per_trait", _SQL_RULE_ACC +
          ", b AS (SELECT trait, fold, acc, row_number() OVER (PARTITION BY trait ORDER BY acc DESC, fold ASC) AS rn FROM acc) "
          "SELECT trait, fold::BIGINT AS fold, round(acc, 6) AS acc FROM b WHERE rn = 1")
def q_best_model_per_trait(spark, sf):
    """Best fold per trait (strictly better wins; earliest fold on ties)."""
    best = M.best_per_group(_accuracy(spark, sf))
    return best.select("trait", F.col("fold").cast("bigint").alias("fold"), r6("acc").alias("acc"))


@register("best_epoch",
          "WITH h AS (SELECT event_type AS trait, user_id % 10 + 1 AS fold, event_id % 15 + 1 AS epoch, value / 100 AS val_acc FROM events), "
          "m AS (SELECT trait, fold, max(val_acc) AS best FROM h GROUP BY 1, 2) "
          "SELECT h.trait, h.fold::BIGINT AS fold, round(m.best, 6) AS best_acc, min(h.epoch)::BIGINT AS best_epoch FROM h JOIN m "
          "ON h.trait = m.trait AND h.fold = m.fold AND h.val_acc = m.best GROUP BY h.trait, h.fold, m.best")
def q_best_epoch(spark, sf):
    """Training-history aggregate: best validation score per (trait, fold)
    and the first epoch reaching it (history derived from ``events``)."""
    ev = load(spark, sf, "events")
    hist = ev.select(F.col("event_type").alias("trait"), (F.col("user_id") % 10 + 1).alias("fold"),
                     (F.col("event_id") % 15 + 1).alias("epoch"), (F.col("value") / 100).alias("val_acc"))
    out = M.best_epoch(hist)
    return out.select("trait", F.col("fold").cast("bigint").alias("fold"), r6("best_acc").alias("best_acc"),
                      F.col("best_epoch").cast("bigint").alias("best_epoch"))


_CONFIG = {"network": "rule", "dataset": "labels", "lr": 0.0005, "batch_size": 32, "epochs": 15,
           "model_input": "psycholinguist", "embed": "none", "layer": "all", "mode": "normal",
           "embed_mode": "mean"}


@register("experiment_log", _SQL_RULE_ACC +
          "SELECT j.jobid::BIGINT AS jobid, trait, fold::BIGINT AS fold, round(acc, 6) AS acc, 'rule' AS network, "
          "'labels' AS dataset, 0.0005::DOUBLE AS lr, 32::BIGINT AS batch_size FROM acc, (SELECT unnest([1, 2]) AS jobid) j")
def q_experiment_log(spark, sf):
    """Per-fold results + run configuration appended twice (two job ids) to
    the append-only log, read back."""
    path = scratch_path(spark, "experiments")
    acc = _accuracy(spark, sf)
    for job in (1, 2):
        WR.append_experiments(M.experiment_rows(acc, dict(_CONFIG, jobid=job)), path)
    back = spark.read.parquet(path)
    return back.select(F.col("jobid").cast("bigint").alias("jobid"), "trait", F.col("fold").cast("bigint").alias("fold"),
                       r6("acc").alias("acc"), "network", "dataset", F.col("lr").cast("double").alias("lr"),
                       F.col("batch_size").cast("bigint").alias("batch_size"))


@register("best_saved_scored", _SQL_RULE_ACC +
          ", b AS (SELECT trait, fold, row_number() OVER (PARTITION BY trait ORDER BY acc DESC, fold ASC) AS rn FROM acc) "
          "SELECT l.doc_id, b.trait, b.fold::BIGINT AS fold, round(1 / (1 + exp(-(0.1 + (0.1 * b.fold - 0.4) * (l.doc_id % 7) + "
          "(0.05 * b.fold - 0.2) * (l.doc_id % 5)))), 6) AS probability FROM labels l, b WHERE b.rn = 1")
def q_best_saved_scored(spark, sf):
    """Each trait's model of its best fold saved with its layer, loaded from the
    registry and applied.  Every fold's model has weights of its own, so the
    scores tell which one was saved."""
    traits, root = ["quality", "toxic"], scratch_path(spark, "best_saved")
    models = {(t, f): M.LinearScorer([0.1 * f - 0.4, 0.05 * f - 0.2], 0.1) for t in traits for f in range(1, 11)}
    best = M.save_best(_accuracy(spark, sf), models, root, "given", layer=3)
    for t in traits:
        M.check_layer(spark, root, "given", t, 3)
    x = load(spark, sf, "labels").select("doc_id", array_to_vector(F.array(
        (F.col("doc_id") % 7).cast("double"), (F.col("doc_id") % 5).cast("double"))).alias("features"))
    out = M.score(x, M.load_models(root, "given", traits))
    fold = F.element_at(F.create_map(*[F.lit(v) for kv in sorted(best.items()) for v in kv]), F.col("trait"))
    return out.select("doc_id", "trait", fold.cast("bigint").alias("fold"), r6("probability").alias("probability"))


# ---- probabilities -------------------------------------------------------------------

# two scores of the whole vector: the sums of its even and of its odd places
_SQL_P = ("SELECT vec_id, 1 / (1 + exp(sum(CASE WHEN i % 2 = 1 THEN x ELSE -x END))) AS p FROM (SELECT vec_id, "
          "unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY vec_id")


def _p1(spark, sf):
    emb = load(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))

    def total(rest):
        return F.aggregate(F.filter("e", lambda x, i: i % 2 == rest), F.lit(0.0), lambda a, x: a + x)
    return emb.select("vec_id", softmax(F.array(total(0), total(1)))[1].alias("p"))


@register("softmax", "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS idx FROM embeddings) "
          "SELECT vec_id, idx::BIGINT AS idx, round(exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id), 6) AS p FROM e")
def q_softmax(spark, sf):
    """Softmax over the whole embedding vector."""
    emb = load(spark, sf, "embeddings")
    p = emb.select("vec_id", F.posexplode(softmax(F.col("embedding").cast("array<double>"))).alias("idx", "p"))
    return p.select("vec_id", F.col("idx").cast("bigint").alias("idx"), r6("p").alias("p"))


@register("score_threshold", f"WITH s AS ({_SQL_P}) SELECT vec_id, round(p, 3) AS p3, "
          "CASE WHEN p > 0.5 THEN 'Yes' ELSE 'No' END AS decision FROM s")
def q_score_threshold(spark, sf):
    """``Yes`` only when strictly above 0.5; probability shown to 3 decimals."""
    p = _p1(spark, sf)
    return p.select("vec_id", round_to("p", 3).alias("p3"),
                    F.when(F.col("p") > 0.5, "Yes").otherwise("No").alias("decision"))


@register("rbf_gamma", "SELECT round(1.0 / (max(len(embedding)) * var_pop(x)), 6) AS gamma FROM "
          "(SELECT embedding, unnest(embedding)::DOUBLE AS x FROM embeddings)")
def q_rbf_gamma(spark, sf):
    """``gamma='scale'`` of the embedding matrix."""
    return M.gamma_scale(load(spark, sf, "embeddings"), "embedding").select(r6("gamma").alias("gamma"))


# ---- attribution --------------------------------------------------------------------

N_DIMS = 64
_W = tuple((i * 7 % 13 - 6) / 4 for i in range(N_DIMS))  # fixed weights of all dimensions
_FEATS = [f"d{i}" for i in range(len(_W))]
_TRAIT_W = {"quality": _W, "toxic": tuple(reversed(_W))}


def _dims(spark, sf):
    emb = load(spark, sf, "embeddings")
    return emb.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(_FEATS)])


def _sql_phi(weights, trait=None):
    parts = []
    for i, (f, w) in enumerate(zip(_FEATS, weights)):
        t = f"'{trait}' AS trait, " if trait else ""
        parts.append(f"SELECT {t}vec_id, '{f}' AS feature, {w} * (embedding[{i + 1}]::DOUBLE - "
                     f"(SELECT avg(embedding[{i + 1}]::DOUBLE) FROM embeddings)) AS phi FROM embeddings")
    return " UNION ALL ".join(parts)


@register("linear_attribution", f"SELECT vec_id, feature, round(phi, 6) AS phi FROM ({_sql_phi(_W)})")
def q_linear_attribution(spark, sf):
    """Exact attributions of a fixed linear model over all embedding dims."""
    phi = X.linear_attribution(_dims(spark, sf), "vec_id", _FEATS, _W)
    return phi.select("vec_id", "feature", r6("phi").alias("phi"))


def _importance(spark, sf):
    dims = _dims(spark, sf)
    parts = [X.linear_attribution(dims, "vec_id", _FEATS, w).withColumn("trait", F.lit(t)) for t, w in _TRAIT_W.items()]
    return X.importance(parts[0].unionByName(parts[1]))


_SQL_IMP = ("WITH phi AS (" + " UNION ALL ".join(_sql_phi(w, t) for t, w in _TRAIT_W.items()) + "), "
            "imp AS (SELECT trait, feature, sum(abs(phi)) AS importance FROM phi GROUP BY 1, 2) ")


@register("importance_topk", _SQL_IMP + ", r AS (SELECT trait, feature, importance, row_number() OVER "
          "(PARTITION BY trait ORDER BY importance DESC, feature ASC) AS rank FROM imp) "
          "SELECT trait, rank::BIGINT AS rank, feature, round(importance, 6) AS importance FROM r WHERE rank <= 3")
def q_importance_topk(spark, sf):
    """Top-3 features per trait by summed absolute attribution."""
    top = X.top_features(_importance(spark, sf), 3)
    return top.select("trait", F.col("rank").cast("bigint").alias("rank"), "feature", r6("importance").alias("importance"))


@register("importance_strongest", _SQL_IMP + "SELECT trait, feature, round(importance, 6) AS importance FROM imp "
          "ORDER BY importance DESC, trait, feature LIMIT 128")
def q_importance_strongest(spark, sf):
    """Frequency table of the 128 strongest (trait, feature) importances (the
    input of the word-cloud picture)."""
    imp = _importance(spark, sf)
    top = imp.orderBy(F.col("importance").desc(), "trait", "feature").limit(128)
    return top.select("trait", "feature", r6("importance").alias("importance"))


@register("importance_table", _SQL_IMP + "SELECT CASE trait WHEN 'toxic' THEN 1 ELSE 2 END::BIGINT AS trait_no, trait, feature, "
          "round(importance, 6) AS importance FROM imp")
def q_importance_table(spark, sf):
    """Importance of every feature, type words stripped from the names, traits
    in their given order, written as a table and read back."""
    imp = _importance(spark, sf).withColumn("feature", F.concat("feature", F.lit(" numeric")))
    imp = X.trait_order(imp.withColumn("feature", X.strip_type("feature")), ["toxic", "quality"])
    path = scratch_path(spark, "importance")
    WR.write_importance(imp, path)
    back = spark.read.csv(path, header=True, schema="trait_no bigint, trait string, feature string, importance double")
    return back.select("trait_no", "trait", "feature", r6("importance").alias("importance"))


# ---- training (rows-only checks) ------------------------------------------------------

def _emb_train(spark, sf):
    emb = load(spark, sf, "embeddings")
    return emb.select("vec_id", array_to_vector("embedding").alias("features"),
                      (F.col("label") % 2).cast("double").alias("odd"),
                      (F.col("label") < 5).cast("double").alias("low"))


def _pred_out(model, df):
    pred = model.transform(df)
    return pred.select("vec_id", F.col("prediction").cast("bigint").alias("prediction"),
                       r6(M.positive_probability(pred)).alias("p1"))


@register("train_lr")
def q_train_lr(spark, sf):
    """L2 logistic regression (C = 1) on embedding vectors, trait ``label odd``."""
    df = _emb_train(spark, sf).withColumnRenamed("odd", "label")
    return _pred_out(M.lr_l2(df.count()).fit(df), df)


@register("train_lr_unreg")
def q_train_lr_unreg(spark, sf):
    df = _emb_train(spark, sf).withColumnRenamed("low", "label")
    return _pred_out(M.lr_unregularised(15).fit(df), df)


@register("train_mlp")
def q_train_mlp(spark, sf):
    """Network 64-50-2 on embedding vectors."""
    df = _emb_train(spark, sf).withColumnRenamed("odd", "label")
    return _pred_out(M.mlp(64, (50,), max_iter=50, seed=0).fit(df), df)


@register("train_mlp_deep")
def q_train_mlp_deep(spark, sf):
    """Network 64-128-50-2; the iteration budget (10, 25, 50; each stage
    continues from the previous weights) is chosen on the validation tail of
    the training rows (best-only), then the test rows are scored."""
    df = FO.holdout_split(_emb_train(spark, sf).withColumnRenamed("low", "label"), "vec_id", seed=0)
    train, val, test = (df.filter(F.col("split") == s) for s in ("train", "val", "test"))
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    best, weights, done = None, None, 0
    for iters in (10, 25, 50):
        # continue from the previous budget's weights instead of restarting
        est = M.mlp(64, (128, 50), max_iter=iters - done, seed=0)
        if weights is not None:
            est.setInitialWeights(weights)
        m = est.fit(train)
        weights, done = m.weights, iters
        acc = M.accuracy(m.transform(val)).first()["acc"]
        if best is None or acc > best[0]:
            best = (acc, iters, m)
    train.unpersist()
    return _pred_out(best[2], test).withColumn("max_iter", F.lit(best[1]))


@register("train_svm")
def q_train_svm(spark, sf):
    """Approximate RBF SVM (random Fourier features, gamma='scale') + linear SVM."""
    df = _emb_train(spark, sf).withColumnRenamed("odd", "label")
    gamma = M.gamma_scale(load(spark, sf, "embeddings"), "embedding").first()["gamma"]
    model = M.rbf_svm(64, gamma, n_components=256, seed=0, max_iter=50).fit(df)
    return _pred_out(model, df)


def _emb_folds(spark, sf):
    """Training rows with a fold per trait, both assigned in one pass."""
    df = _emb_train(spark, sf)
    traits = ["odd", "low"]
    folds = FO.stratified_folds(df.select("vec_id", *traits).unpivot(["vec_id"], traits, "trait", "y"), "y", "vec_id",
                                k=10, by=["trait"])
    wide = folds.groupBy("vec_id").agg(*[F.max(F.when(F.col("trait") == t, F.col("fold"))).alias(f"fold_{t}") for t in traits])
    return df.join(wide, "vec_id").checkpoint()


@register("cv_results")
def q_cv_results(spark, sf):
    """10-fold cross-validation of the L2 logistic model for two traits:
    ``(trait, fold, acc)``; all traits and folds share every scan."""
    return NW.fit_folds(_emb_folds(spark, sf), ["odd", "low"], k=10).accuracies()


# Newton's method in SQL: mean valence and arousal of a document's words (and an
# intercept), ten steps for every trait and fold, the 3 x 3 system by determinants.
def _sql_newton(steps: int = 10) -> str:
    sums = {"g0": "sum(p - y)", "g1": "sum((p - y) * x1) + any_value(b1)", "g2": "sum((p - y) * x2) + any_value(b2)",
            "h00": "sum(p * (1 - p))", "h01": "sum(p * (1 - p) * x1)", "h02": "sum(p * (1 - p) * x2)",
            "h11": "sum(p * (1 - p) * x1 * x1) + 1", "h12": "sum(p * (1 - p) * x1 * x2)", "h22": "sum(p * (1 - p) * x2 * x2) + 1"}

    def det(*c):
        return "({0} * ({4} * {8} - {5} * {7}) - {1} * ({3} * {8} - {5} * {6}) + {2} * ({3} * {7} - {4} * {6}))".format(*c)
    h = ["h00", "h01", "h02", "h01", "h11", "h12", "h02", "h12", "h22"]
    put = lambda j: [f"g{i // 3}" if i % 3 == j else v for i, v in enumerate(h)]
    out = [f"vad AS MATERIALIZED ({q_text.ORACLE['lexicon_vad']})",
           "d AS MATERIALIZED (SELECT f.trait, f.fold, f.y::DOUBLE AS y, coalesce(v.valence, 0) AS x1, coalesce(v.arousal, 0) AS x2 "
           "FROM folds f JOIN vad v ON v.doc_id = f.doc_id)",
           "w0 AS (SELECT trait, f, 0::DOUBLE AS b0, 0::DOUBLE AS b1, 0::DOUBLE AS b2 FROM (SELECT DISTINCT trait FROM d), "
           "(SELECT unnest(range(0, 10)) AS f))"]
    for i in range(steps):
        out.append(f"s{i} AS MATERIALIZED (SELECT trait, f, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, "
                   + ", ".join(f"{v} AS {k}" for k, v in sums.items())
                   + f" FROM (SELECT w.*, d.y, d.x1, d.x2, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p FROM w{i} w "
                     "JOIN d ON d.trait = w.trait AND d.fold <> w.f) GROUP BY trait, f)")
        out.append(f"w{i + 1} AS MATERIALIZED (SELECT trait, f, " + ", ".join(
            f"b{j} - {det(*put(j))} / {det(*h)} AS b{j}" for j in range(3)) + f" FROM s{i})")
    return _SQL_STRAT + ", " + ",\n".join(out) + f", fit AS (SELECT * FROM w{steps}) "


_SQL_NEWTON = _sql_newton()


def _vad_folds(spark, sf):
    """Labelled documents: valence and arousal (missing: 0) as features, nothing
    else, and a stratified fold per trait."""
    traits = ["quality", "toxic"]
    lab = load(spark, sf, "labels")
    vad = q_text.q_lexicon_vad(spark, sf).select("doc_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("valence", "arousal")])
    folds = FO.stratified_folds(lab.unpivot(["doc_id"], traits, "trait", "y"), "y", "doc_id", k=10, by=["trait"])
    wide = folds.groupBy("doc_id").agg(*[F.max(F.when(F.col("trait") == t, F.col("fold"))).alias(f"fold_{t}") for t in traits],
                                       *[F.max(F.when(F.col("trait") == t, F.col("y"))).alias(t) for t in traits])
    # read by the kernel width and by every fit: the texts are counted once
    return vad.join(wide, "doc_id").withColumn("features", F.array("valence", "arousal")).checkpoint(), traits


@register("cv_psycho", _SQL_NEWTON + "SELECT d.trait, (d.fold + 1)::BIGINT AS fold, round(avg(CASE WHEN (fit.b0 + fit.b1 * d.x1 + fit.b2 * d.x2 > 0) "
          "= (d.y > 0.5) THEN 1 ELSE 0 END), 6) AS acc FROM d JOIN fit ON fit.trait = d.trait AND fit.f = d.fold GROUP BY d.trait, d.fold")
def q_cv_psycho(spark, sf):
    """Cross-validated L2 logistic models on psycholinguistic scores alone."""
    df, traits = _vad_folds(spark, sf)
    out = NW.fit_folds(df, traits, k=10).accuracies()
    return out.select("trait", F.col("fold").cast("bigint").alias("fold"), r6("acc").alias("acc"))


@register("cv_psycho_weights", _SQL_NEWTON + "SELECT trait, (f + 1)::BIGINT AS fold, round(b0, 5) AS intercept, round(b1, 5) AS valence, "
          "round(b2, 5) AS arousal FROM fit")
def q_cv_psycho_weights(spark, sf):
    """The weights of these models: the minimum of each fold's own loss."""
    df, traits = _vad_folds(spark, sf)
    w = NW.fit_folds(df, traits, k=10).coefficients()
    return w.select("trait", F.col("fold").cast("bigint").alias("fold"), round_to("intercept", 5).alias("intercept"),
                    *[round_to(F.col("weights")[i], 5).alias(c) for i, c in enumerate(("valence", "arousal"))])


@register("cv_combined")
def q_cv_combined(spark, sf):
    """Cross-validated L2 logistic models on the combined input (hashing
    embedding of each labelled document + emotion and VAD lexicon scores),
    stratified folds per trait: ``(trait, fold, acc)``."""
    from ..operators import features as FE
    from ..operators import lexicon as LX
    docs = load(spark, sf, "documents").select("doc_id", "text")
    toks = docs.select("doc_id", T.tokenize_batches(F.lower(F.col("text"))).alias("toks"))
    emb = V.hashing_embed_docs(toks, "doc_id", "toks", dim=DIM, batches=True).withColumnRenamed("doc_id", "author_id") \
        .withColumn("vec", F.coalesce("vec", F.array(*[F.lit(0.0)] * DIM)))
    psycho = LX.lexicon_features_multi(docs, {"emotion": (D.emotion_lexicon(spark, sf), D.EMOTIONS),
                                              "vad": (D.vad_lexicon(spark, sf), D.VAD)}) \
        .withColumnRenamed("doc_id", "author_id")
    x = FE.assemble_inputs("combined", emb, psycho)
    lab = load(spark, sf, "labels").withColumnRenamed("doc_id", "author_id")
    # the folds of both traits read these rows too: the texts are featurised once
    df = x.join(lab, "author_id").checkpoint()
    for t in ("quality", "toxic"):
        f = FO.stratified_folds(df.select("author_id", t), t, "author_id", k=10) \
            .select("author_id", F.col("fold").alias(f"fold_{t}"))
        df = df.join(f, "author_id")
    return M.cross_validate(df.checkpoint(), ["quality", "toxic"], lambda n, t: M.lr_l2(n), k=10)


@register("cv_mlp")
def q_cv_mlp(spark, sf):
    """10-fold cross-validation of the network 64-50-2 for two traits."""
    return M.cross_validate(_emb_folds(spark, sf), ["odd", "low"], lambda n, t: M.mlp(N_DIMS, (50,), max_iter=20, seed=0), k=10)


@register("cv_svm")
def q_cv_svm(spark, sf):
    """10-fold cross-validation of the approximate RBF SVM for two traits."""
    gamma = M.gamma_scale(load(spark, sf, "embeddings"), "embedding").first()["gamma"]
    return M.cross_validate(_emb_folds(spark, sf), ["odd", "low"],
                            lambda n, t: M.rbf_svm(N_DIMS, gamma, n_components=128, seed=0, max_iter=20), k=10)


@register("cv_best_scored")
def q_cv_best_scored(spark, sf):
    """Cross-validation, experiment log, each trait's best fold saved with its
    layer, loaded again and applied to all rows: ``(vec_id, trait, probability,
    decision)``."""
    root = scratch_path(spark, "best_models")
    df = _emb_folds(spark, sf)
    res, models = M.cross_validate(df, ["odd", "low"], lambda n, t: M.lr_l2(n), k=10, keep_models=True)
    WR.append_experiments(M.experiment_rows(res, dict(_CONFIG, jobid=1)), f"{root}/log")
    M.save_best(spark.read.parquet(f"{root}/log"), models, root, "lr", layer=1)
    for t in ("odd", "low"):
        M.check_layer(spark, root, "lr", t, 1)
    out = M.score(df.select("vec_id", "features"), M.load_models(root, "lr", ["odd", "low"]), key="vec_id")
    return out.select("vec_id", "trait", r6("probability").alias("probability"), "decision")


@register("train_facts", "SELECT * FROM (VALUES ('lr_l2', 'gradient', true), ('lr_l2', 'loss', true), ('lr_unreg', 'loss', true), "
          "('mlp', 'loss', true), ('svm', 'accuracy', true), ('cv', 'folds', true)) t(model, fact, holds)")
def q_train_facts(spark, sf):
    """Facts that every right training result shows: the L2 objective's gradient
    vanishes at its solution, the loss is below the zero model's, the SVM is
    above the majority class, and each fold holds a tenth of each class."""
    df = _emb_train(spark, sf).withColumnRenamed("odd", "label").checkpoint()
    n, ones = df.agg(F.count("*"), F.sum("label")).first()

    def loss(model):
        p = F.greatest(F.least(M.positive_probability(model.transform(df)), F.lit(1 - 1e-15)), F.lit(1e-15))
        return model.transform(df).agg(F.avg(-F.when(F.col("label") > 0, F.log(p)).otherwise(F.log(1 - p)))).first()[0]

    lr = M.lr_l2(n).fit(df)
    err = vector_to_array("probability")[1] - F.col("label")
    d = lr.transform(df).select(array_to_vector(F.transform(vector_to_array("features"), lambda x: x * err)).alias("g"))
    grad = d.agg(Summarizer.sum(F.col("g")).alias("g")).first()["g"].toArray() + lr.coefficients.toArray()
    svm = M.rbf_svm(N_DIMS, M.gamma_scale(load(spark, sf, "embeddings"), "embedding").first()["gamma"], 256, 0, max_iter=50).fit(df)
    majority = max(ones, n - ones) / n
    folds = FO.stratified_folds(df.select("vec_id", "label"), "label", "vec_id", k=10)
    per = folds.groupBy("label", "fold").count().groupBy("label").agg((F.max("count") - F.min("count")).alias("d"))
    facts = [("lr_l2", "gradient", float(abs(grad).max()) < 0.01 * n ** 0.5), ("lr_l2", "loss", loss(lr) < 0.6932),
             ("lr_unreg", "loss", loss(M.lr_unregularised(15).fit(df)) < 0.6932),
             ("mlp", "loss", loss(M.mlp(N_DIMS, (50,), max_iter=50, seed=0).fit(df)) < 0.6932),
             ("svm", "accuracy", bool(M.accuracy(svm.transform(df)).first()["acc"] >= majority)),
             ("cv", "folds", all(r["d"] <= 1 for r in per.collect()))]
    return spark.createDataFrame([(a, b, bool(c)) for a, b, c in facts], "model string, fact string, holds boolean")


# ---- scoring with given coefficients --------------------------------------------------------

_FIXED = {"quality": (_W, 0.25), "toxic": (tuple(reversed(_W)), -0.5)}


def _fixed_models(spark):
    """Two models of given coefficients, saved to the registry and loaded."""
    root = scratch_path(spark, "fixed_models")
    for t, (w, b) in _FIXED.items():
        M.save_model(M.LinearScorer(w, b), root, "fixed", t)
    return M.load_models(root, "fixed", list(_FIXED))


def _hash_features(docs):
    toks = docs.select("doc_id", T.tokenize_batches(F.lower(F.col("text"))).alias("toks"))
    vec = V.hashing_embed_docs(toks, "doc_id", "toks", dim=64, batches=True)
    return vec.select("doc_id", F.when(F.col("vec").isNotNull(), array_to_vector("vec")).alias("features"))


_SQL_FIXED = _SQL_HASH + ", z AS (" + " UNION ALL ".join(
    f"SELECT d.doc_id, '{t}' AS trait, {b} + sum(v.value * ([{', '.join(map(str, w))}])[v.bucket + 1]) AS z FROM documents d "
    "LEFT JOIN dense v ON v.doc_id = d.doc_id GROUP BY d.doc_id" for t, (w, b) in _FIXED.items()) + (
    ") SELECT doc_id, trait, round(1 / (1 + exp(-z)), 6) AS probability, "
    "CASE WHEN z IS NULL THEN NULL WHEN 1 / (1 + exp(-z)) > 0.5 THEN 'Yes' ELSE 'No' END AS decision FROM z")


@register("score_fixed", _SQL_FIXED)
def q_score_fixed(spark, sf):
    """Registry models of given coefficients scoring every document's hashing
    vector: ``(doc_id, trait, probability, decision)``."""
    docs = load(spark, sf, "documents").select("doc_id", "text")
    out = M.score(_hash_features(docs), _fixed_models(spark))
    return out.select("doc_id", "trait", r6("probability").alias("probability"), "decision")


@register("stream_score_fixed", _SQL_FIXED)
def q_stream_score_fixed(spark, sf):
    """The same models scoring a file stream of documents."""
    out = ST.score_stream(spark, _stream_source(spark, sf), "doc_id long, text string", _hash_features, _fixed_models(spark),
                          scratch_path(spark, "stream_fixed_sink"), scratch_path(spark, "stream_fixed_ckpt"))
    return out.select("doc_id", "trait", r6("probability").alias("probability"), "decision")


# ---- scoring unseen text ------------------------------------------------------------------

WIN, OVERLAP, DIM = 64, 16, 64


def window_features(docs, key: str = "doc_id", text: str = "text"):
    """clean -> lower-case tokens -> overlapping windows -> hashing vector per
    window -> mean over the document's windows: ``(key, features)``; a
    document without tokens gets NULL features.  All of it happens inside the
    document's row."""
    toks = docs.select(key, T.tokenize_batches(F.lower(T.clean_text(F.col(text)))).alias("toks"))
    pooled = V.hashing_window_mean(toks, key, "toks", WIN, OVERLAP, dim=DIM, batches=True)
    return pooled.select(key, F.when(F.col("vec").isNotNull(), array_to_vector("vec")).alias("features"))


def _train_models(spark, sf, root, feats=None):
    """One L2 logistic model per trait on the labelled documents' features,
    saved under ``root`` and loaded back (the registry round trip)."""
    if feats is None:  # only labelled documents are featurised
        docs = load(spark, sf, "documents").select("doc_id", "text")
        feats = window_features(docs.join(load(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi"))
    lab = feats.filter(F.col("features").isNotNull()).join(load(spark, sf, "labels"), "doc_id").checkpoint()
    n = lab.count()
    for t in ("quality", "toxic"):
        m = M.lr_l2(n).fit(lab.withColumn("label", F.col(t).cast("double")))
        M.save_model(m, root, "lr", t)
    return M.load_models(root, "lr", ["quality", "toxic"])


@register("score_unseen")
def q_score_unseen(spark, sf):
    """Per-trait models trained on windowed hashing vectors of labelled
    documents, saved, reloaded, and applied to every document:
    ``(doc_id, trait, probability, decision)``."""
    docs = load(spark, sf, "documents").select("doc_id", "text")
    # featurised once (lineage cut on the shared checkpoint folder), used for
    # training on the labelled documents and for scoring every document
    feats = window_features(docs).checkpoint()
    models = _train_models(spark, sf, scratch_path(spark, "models"), feats)
    out = M.score(feats, models)
    return out.select("doc_id", "trait", r6("probability").alias("probability"), "decision")


@register("sampled_attribution")
def q_sampled_attribution(spark, sf):
    """Sampled Shapley values of a logistic model over all embedding dims:
    fitted on the training split of the seeded 80/20 hold-out, every test row
    explained with 16 samples, background rows drawn from the whole training
    split."""
    dims = _dims(spark, sf)
    lab = load(spark, sf, "embeddings").select("vec_id", (F.col("label") % 2).cast("double").alias("label"))
    df = dims.join(lab, "vec_id").withColumn(
        "features", array_to_vector(F.array(*[F.col(f) for f in _FEATS])))
    split = FO.holdout_split(df, "vec_id", seed=0, val_frac=0.0).checkpoint()
    train, test = split.filter(F.col("split") != "test"), split.filter(F.col("split") == "test")
    model = M.lr_l2(train.count()).fit(train)
    phi = X.sampled_attribution(model, test, train, "vec_id", "features", len(_FEATS), samples=16, seed=0)
    return phi.select("vec_id", F.col("feature").cast("bigint").alias("feature"), r6("phi").alias("phi"))


@register("attribution_svm")
def q_attribution_svm(spark, sf):
    """The same for the approximate RBF SVM, with standard errors from antithetic
    pairs of walks."""
    split = FO.holdout_split(_emb_train(spark, sf).withColumnRenamed("odd", "label"), "vec_id", seed=0, val_frac=0.0).checkpoint()
    train, test = split.filter(F.col("split") != "test"), split.filter(F.col("split") == "test")
    gamma = M.gamma_scale(load(spark, sf, "embeddings"), "embedding").first()["gamma"]
    model = M.rbf_svm(N_DIMS, gamma, n_components=128, seed=0, max_iter=20).fit(train)
    phi = X.sampled_attribution(model, test, train, "vec_id", "features", N_DIMS, samples=8, seed=0, errors=True)
    return phi.select("vec_id", F.col("feature").cast("bigint").alias("feature"), r6("phi").alias("phi"), r6("se").alias("se"))


@register("cv_svm_psycho")
def q_cv_svm_psycho(spark, sf):
    """Cross-validated approximate RBF SVM on psycholinguistic scores alone."""
    df, traits = _vad_folds(spark, sf)
    gamma = M.gamma_scale(df, "features").first()["gamma"]
    df = df.withColumn("features", array_to_vector("features")).checkpoint()
    # reg = 1 / (n C) with C = 1, as for the logistic model
    return M.cross_validate(df, traits, lambda n, t: M.rbf_svm(2, gamma, n_components=64, seed=0, reg=1.0 / n, max_iter=20), k=10)


@register("cv_mlp_psycho")
def q_cv_mlp_psycho(spark, sf):
    """Cross-validated networks 2-50-2 on psycholinguistic scores alone."""
    df, traits = _vad_folds(spark, sf)
    df = df.withColumn("features", array_to_vector("features")).checkpoint()
    return M.cross_validate(df, traits, lambda n, t: M.mlp(2, (50,), max_iter=20, seed=0), k=10)


@register("importance_mlp")
def q_importance_mlp(spark, sf):
    """Networks on the emotion and VAD scores of the labelled documents, one a
    trait; sampled attributions of every test row, summed to an importance per
    trait (in trait order) and named feature."""
    from .q_io import _labels_keyed, _lexicon_groups
    feats, traits = [*D.EMOTIONS, *D.VAD], ["toxic", "quality"]
    x = FE.label_join(_lexicon_groups(spark, sf), _labels_keyed(spark, sf))
    x = FO.holdout_split(FE.assemble(x, feats), "author_id", seed=0, val_frac=0.0).checkpoint()
    train, test = x.filter(F.col("split") != "test"), x.filter(F.col("split") == "test")
    parts = []
    for t in traits:
        model = M.mlp(len(feats), (8,), max_iter=30, seed=0).fit(train.withColumn("label", F.col(t).cast("double")))
        phi = X.sampled_attribution(model, test, train, "author_id", "features", len(feats), samples=8, seed=0)
        parts.append(phi.withColumn("trait", F.lit(t)))
    named = parts[0].unionByName(parts[1]).withColumn(
        "feature", F.element_at(F.array(*[F.lit(f) for f in feats]), (F.col("feature") + 1).cast("int")))
    return X.trait_order(X.importance(named), traits).select("trait_no", "trait", "feature", r6("importance").alias("importance"))


# ---- streaming -------------------------------------------------------------------------------

def _stream_source(spark, sf, rows_per_file: int = 20_000) -> str:
    """Copy of ``documents`` as the files of a stream, as many as the data needs."""
    src = scratch_path(spark, "stream_src")
    load(spark, sf, "documents").select("doc_id", "text").write.option("maxRecordsPerFile", rows_per_file).parquet(src)
    return src


@register("stream_lexicon", q_text.ORACLE["lexicon_vad"])
def q_stream_lexicon(spark, sf):
    """Documents as a file stream (availableNow, a bounded number of files per
    micro-batch), lexicon means per batch; equals the batch ``lexicon_vad``."""
    src = _stream_source(spark, sf)
    out = ST.lexicon_stream(spark, src, "doc_id long, text string", D.vad_lexicon(spark, sf), D.VAD,
                            scratch_path(spark, "stream_lex_sink"), scratch_path(spark, "stream_lex_ckpt"))
    return out.select("doc_id", *[r6(s).alias(s) for s in D.VAD])


@register("stream_score")
def q_stream_score(spark, sf):
    """Saved per-trait models scoring a file stream of documents."""
    models = _train_models(spark, sf, scratch_path(spark, "models"))
    src = _stream_source(spark, sf)
    out = ST.score_stream(spark, src, "doc_id long, text string", window_features, models,
                          scratch_path(spark, "stream_score_sink"), scratch_path(spark, "stream_score_ckpt"))
    return out.select("doc_id", "trait", r6("probability").alias("probability"), "decision")



