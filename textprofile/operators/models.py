"""Classifiers, cross-validation, experiment records, model registry, scoring.

Training uses Spark ML estimators (distributed optimisers over cached
DataFrames).  The cross-validation driver loop only submits fits and
collects the traits x folds accuracy numbers; the data never leaves the
executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import (HasFeaturesCol, HasInputCol, HasOutputCol, HasPredictionCol,
                                     HasProbabilityCol, Param, Params, TypeConverters)
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import softmax

# ---------------------------------------------------------------------------
# estimators


def lr_l2(n_train: int, c: float = 1.0, max_iter: int = 100, features: str = "features",
          label: str = "label") -> LogisticRegression:
    """L2 logistic regression with the ``C`` objective
    ``0.5 |w|^2 + C * sum(logloss)``: Spark's ``(1/n) sum + (reg/2)|w|^2``
    matches with ``reg = 1 / (n * C)`` and no standardisation."""
    return LogisticRegression(featuresCol=features, labelCol=label, regParam=1.0 / (n_train * c),
                              elasticNetParam=0.0, standardization=False, maxIter=max_iter)


def lr_unregularised(epochs: int = 15, features: str = "features", label: str = "label") -> LogisticRegression:
    """Linear two-logit model = unregularised logistic regression."""
    return LogisticRegression(featuresCol=features, labelCol=label, regParam=0.0, maxIter=epochs)


def mlp(n_features: int, hidden: Sequence[int] = (50,), max_iter: int = 100, seed: int = 0,
        features: str = "features", label: str = "label") -> MultilayerPerceptronClassifier:
    """Feed-forward network ``[d, hidden..., 2]`` (sigmoid hidden units, L-BFGS)."""
    return MultilayerPerceptronClassifier(featuresCol=features, labelCol=label,
                                          layers=[n_features, *hidden, 2], maxIter=max_iter, seed=seed)


class RandomFourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable,
                            DefaultParamsWritable):
    """RBF kernel approximation ``z(x) = sqrt(2/D) cos(Wx + b)``,
    ``W ~ N(0, 2 gamma)``, ``b ~ U(0, 2 pi)`` (Rahimi & Recht 2007).

    The projection is a seeded ``d x D`` matrix rebuilt from the seed (its size
    is fixed by ``D`` and ``d``, not by the data); each Arrow batch is projected
    with one numpy matrix product inside the executors."""

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    n_components = Param(Params._dummy(), "n_components", "D", TypeConverters.toInt)
    n_features = Param(Params._dummy(), "n_features", "d", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    def __init__(self, inputCol: str = "features", outputCol: str = "rff", gamma: float = 1.0,
                 n_components: int = 512, n_features: int = 1, seed: int = 0):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, gamma=gamma, n_components=n_components,
                  n_features=n_features, seed=seed)

    def projection(self) -> tuple[np.ndarray, np.ndarray, float]:
        """``(W, b, sqrt(2/D))``, the same whenever they are drawn."""
        g, d_out = self.getOrDefault(self.gamma), self.getOrDefault(self.n_components)
        rng = np.random.default_rng(self.getOrDefault(self.seed))
        w = rng.normal(0.0, math.sqrt(2.0 * g), size=(self.getOrDefault(self.n_features), d_out))
        return w, rng.uniform(0.0, 2.0 * math.pi, size=d_out), math.sqrt(2.0 / d_out)

    def _transform(self, df: DataFrame) -> DataFrame:
        d_in = self.getOrDefault(self.n_features)
        w, b, scale = self.projection()

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            # one Arrow batch -> one matrix product; W is fixed-size (D x d)
            mat = np.vstack(x.to_numpy()) if len(x) else np.zeros((0, d_in))
            z = scale * np.cos(mat @ w + b)
            return pd.Series(list(z))

        return df.withColumn(self.getOutputCol(),
                             array_to_vector(project(vector_to_array(F.col(self.getInputCol())))))


class LinearScorer(Transformer, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, DefaultParamsReadable,
                   DefaultParamsWritable):
    """A logistic score with given coefficients, e.g. published ones, that can
    stand in the model registry next to fitted models."""

    coefficients = Param(Params._dummy(), "coefficients", "one weight a feature", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "intercept", TypeConverters.toFloat)

    def __init__(self, coefficients: Sequence[float] = (), intercept: float = 0.0, featuresCol: str = "features"):
        super().__init__()
        self._set(coefficients=list(coefficients), intercept=intercept, featuresCol=featuresCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        w = F.array(*[F.lit(float(x)) for x in self.getOrDefault(self.coefficients)])
        z = F.aggregate(F.zip_with(vector_to_array(self.getFeaturesCol()), w, lambda a, b: a * b),
                        F.lit(float(self.getOrDefault(self.intercept))), lambda a, x: a + x)
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
        return df.withColumn(self.getProbabilityCol(), array_to_vector(F.array(F.lit(1.0) - p, p))) \
            .withColumn(self.getPredictionCol(), (p > 0.5).cast("double"))


def gamma_scale(df: DataFrame, vec: str) -> DataFrame:
    """One row ``gamma``: ``1 / (d * var(X))`` over all entries of the feature
    matrix (population variance), i.e. ``gamma='scale'``.  One partially
    aggregated pass over the exploded values."""
    vals = df.select(F.size(vec).alias("_d"), F.explode(vec).alias("_x"))
    return vals.agg((F.lit(1.0) / (F.max("_d") * F.var_pop(F.col("_x").cast("double")))).alias("gamma"))


def rbf_svm(n_features: int, gamma: float, n_components: int = 512, seed: int = 0,
            features: str = "features", label: str = "label", reg: float = 0.0, max_iter: int = 100) -> Pipeline:
    """Approximate RBF-kernel SVM: random Fourier features + linear SVM."""
    rff = RandomFourierFeatures(features, "_rff", gamma=gamma, n_components=n_components,
                                n_features=n_features, seed=seed)
    svc = LinearSVC(featuresCol="_rff", labelCol=label, regParam=reg, maxIter=max_iter)
    return Pipeline(stages=[rff, svc])


# ---------------------------------------------------------------------------
# evaluation


def accuracy(pred: DataFrame, group: Sequence[str] = (), label: str = "label",
             prediction: str = "prediction") -> DataFrame:
    """Share of rows with ``prediction == label`` per group."""
    hit = (F.col(prediction).cast("double") == F.col(label).cast("double")).cast("int")
    return pred.groupBy(*group).agg(F.avg(hit).alias("acc"))


def best_per_group(results: DataFrame, group: str = "trait", score: str = "acc",
                   tie: str = "fold") -> DataFrame:
    """Best row per group: strictly higher score wins, so the earliest ``tie``
    wins on equal scores.  Partitioned by the group; results hold one row per
    (group, fold)."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(tie).asc())
    return results.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def best_epoch(history: DataFrame, keys: Sequence[str] = ("trait", "fold"), epoch: str = "epoch",
               score: str = "val_acc") -> DataFrame:
    """Highest score over epochs per key and the first epoch that reached it."""
    return history.groupBy(*keys).agg(F.max(score).alias("best_acc"),
                                      F.min_by(epoch, F.struct(-F.col(score), F.col(epoch))).alias("best_epoch"))


# ---------------------------------------------------------------------------
# cross-validation


def cross_validate(df: DataFrame, traits: Sequence[str], make_estimator: Callable[[int, str], object],
                   fold_col: str = "fold", features: str = "features", k: int | None = None,
                   parallelism: int = 8, keep_models: bool = False):
    """For every trait and fold: fit on the other folds, score the fold, log
    the accuracy.  ``df`` holds ``features``, one 0/1 column per trait and
    ``fold_<trait>`` (or a shared ``fold_col``).  Returns a DataFrame
    ``(trait, fold, acc)`` with 1-based fold numbers, plus the fitted models
    when ``keep_models``.  The input is cached once; fits run in a bounded
    thread pool, each a distributed Spark ML job."""
    spark = df.sparkSession
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    jobs = []
    for t in traits:
        fc = f"fold_{t}" if f"fold_{t}" in df.columns else fold_col
        # one aggregate gives every fold's size (traits x folds numbers)
        sizes = {r[0]: r[1] for r in cached.groupBy(fc).count().collect()}
        total = sum(sizes.values())
        folds = k or (max(sizes) + 1)
        jobs += [(t, fc, f, total - sizes.get(f, 0)) for f in range(folds)]

    def run(job):
        t, fc, f, n_train = job
        train = cached.filter(F.col(fc) != f).withColumn("label", F.col(t).cast("double"))
        test = cached.filter(F.col(fc) == f).withColumn("label", F.col(t).cast("double"))
        model = make_estimator(n_train, t).fit(train)
        acc = accuracy(model.transform(test)).first()["acc"]
        return t, f + 1, float(acc) if acc is not None else None, model

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        out = list(pool.map(run, jobs))
    cached.unpersist()
    res = spark.createDataFrame([(t, f, a) for t, f, a, _ in out], "trait string, fold int, acc double")
    if keep_models:
        return res, {(t, f): m for t, f, _, m in out}
    return res


def experiment_rows(results: DataFrame, config: dict) -> DataFrame:
    """Attach the run configuration as constant columns."""
    return results.withColumns({k: F.lit(v) for k, v in config.items()})


# ---------------------------------------------------------------------------
# model registry and scoring


def model_path(root: str, kind: str, trait: str) -> str:
    return f"{root.rstrip('/')}/{kind}/{trait}"


def save_model(model, root: str, kind: str, trait: str) -> str:
    path = model_path(root, kind, trait)
    pm = model if isinstance(model, PipelineModel) else PipelineModel(stages=[model])
    pm.write().overwrite().save(path)
    return path


def _exists(path: str) -> bool:
    sc = SparkSession.getActiveSession().sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)


def load_models(root: str, kind: str, traits: Sequence[str]) -> dict[str, PipelineModel]:
    """One model per trait; a missing model aborts with a clear message."""
    out = {}
    for t in traits:
        path = model_path(root, kind, t)
        if not _exists(path):
            raise FileNotFoundError(f"no saved {kind} model for trait {t!r} at {path}")
        out[t] = PipelineModel.load(path)  # a model that is there but can't be read says why
    return out


def save_best(results: DataFrame, models: dict, root: str, kind: str, layer: int | None = None) -> dict[str, int]:
    """Save each trait's model of its best fold (earliest on ties), with the
    embedding layer that it was trained on: trait -> 1-based fold."""
    spark = results.sparkSession
    best = {r["trait"]: r["fold"] for r in best_per_group(results).collect()}  # one row a trait
    for trait, fold in best.items():
        path = save_model(models[trait, fold], root, kind, trait)
        spark.createDataFrame([(fold, layer)], "fold int, layer int").coalesce(1).write.mode("overwrite").json(f"{path}.meta")
    return best


def check_layer(spark: SparkSession, root: str, kind: str, trait: str, layer: int | None) -> None:
    """Abort when a saved model was trained on another layer."""
    meta = spark.read.schema("fold int, layer int").json(f"{model_path(root, kind, trait)}.meta").first()
    if meta["layer"] != layer:
        raise ValueError(f"the {kind} model of {trait!r} was trained on layer {meta['layer']}, not {layer}")


def positive_probability(pred: DataFrame, prob: str = "probability", raw: str = "rawPrediction") -> Column:
    """Probability of class 1: the probability vector when the model has one,
    else the logistic function of the SVM margin ``m`` (``rawPrediction`` is
    ``[-m, m]``)."""
    if prob in pred.columns:
        return vector_to_array(prob)[1]
    r = vector_to_array(raw)
    return softmax(F.array(F.lit(0.0), r[1]))[1]


def _renamed_outputs(model: PipelineModel, trait: str) -> PipelineModel:
    """Copy of the model whose last stage writes trait-specific output columns."""
    m = model.copy()
    last = m.stages[-1]
    for param, col in (("predictionCol", f"_pred_{trait}"), ("probabilityCol", f"_prob_{trait}"),
                       ("rawPredictionCol", f"_raw_{trait}")):
        if last.hasParam(param):
            last._set(**{param: col})
    return m


def num_features(model: PipelineModel) -> int:
    """Width of the feature vectors a saved model takes."""
    first = model.stages[0]
    if isinstance(first, LinearScorer):
        return len(first.getOrDefault(first.coefficients))
    return first.getOrDefault("n_features") if first.hasParam("n_features") else first.numFeatures


def score(df: DataFrame, models: dict[str, PipelineModel], key: str = "doc_id",
          features: str = "features") -> DataFrame:
    """``(key, trait, probability, decision)``; decision ``Yes`` only when the
    probability is strictly above 0.5.  All trait models are chained over one
    pass of the input (trait-specific output columns), then unpivoted; rows
    without features are scored as a zero vector in the same pass and get NULL
    probability and decision."""
    n = num_features(next(iter(models.values())))
    none = F.array(*[F.lit(0.0)] * n)
    out = df.withColumn("_has", F.col(features).isNotNull()).withColumn(
        features, F.coalesce(F.col(features), array_to_vector(none)))
    probs = {}
    for trait, m in models.items():
        out = _renamed_outputs(m, trait).transform(out)
        probs[trait] = positive_probability(out, f"_prob_{trait}", f"_raw_{trait}")
    long = out.select(key, *[F.when(F.col("_has"), p).alias(t) for t, p in probs.items()]).unpivot([key], list(models), "trait", "probability")
    return long.withColumn("decision", F.when(F.col("probability") > 0.5, "Yes")
                           .when(F.col("probability").isNotNull(), "No"))


def assemble_vector(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Vector column from array or numeric columns (arrays become vectors)."""
    conv = []
    tmp = df
    for c in cols:
        if tmp.schema[c].dataType.typeName() == "array":
            tmp = tmp.withColumn(f"_v_{c}", array_to_vector(F.col(c)))
            conv.append(f"_v_{c}")
        else:
            conv.append(c)
    out_df = VectorAssembler(inputCols=conv, outputCol=out, handleInvalid="error").transform(tmp)
    return out_df.drop(*[c for c in conv if c.startswith("_v_")])
