"""Linear classifiers with Spark ML, class weights, and the weighted blend of several models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, NGram, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribeprint.functions.scoring import argmax2
from scribeprint.operators.encoding import text_tokens
from scribeprint.operators.vectors import bucket_counts
from scribeprint.session import shared_dir

MAX_ITERATIONS = 1000
TEXT_WEIGHT, TREE_WEIGHT = 0.6, 0.4


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """One row per class: its count, and n / (number of classes * count)."""
    totals = df.groupBy(label).agg(F.count("*").alias("n_class"))
    whole = totals.agg(F.struct(F.sum("n_class").alias("n"), F.count("*").alias("k")).alias("t"))
    return (totals.withColumn("t", whole.scalar())
                  .select(label, "n_class", (F.col("t.n").cast("double")
                                             / (F.col("t.k") * F.col("n_class"))).alias("weight")))


def with_balanced_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """``df`` plus the weight of its class, for labels 0 and 1. The counts are one row."""
    counts = df.agg(F.struct(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("n1"),
                             F.count_if(F.col(label) == 0).alias("n0")).alias("t"))
    t = F.col("__t")
    k = (t["n0"] > 0).cast("int") + (t["n1"] > 0).cast("int")
    own = F.when(F.col(label) == 1, t["n1"]).otherwise(t["n0"])
    return df.withColumn("__t", counts.scalar()).withColumn(
        out, t["n"].cast("double") / (k * own)).drop("__t")


def fit_classifier(train: DataFrame, features: str = "features", label: str = "label",
                   c: float = 1.0, max_iterations: int = MAX_ITERATIONS,
                   tol: float = 1e-6) -> LogisticRegressionModel:
    """L2 logistic regression with balanced classes and a free intercept.

    The objective is half the squared norm plus ``c`` times the sum of weighted
    losses. Spark divides the losses by the sum of the weights, which for
    balanced weights is the number of rows, so the penalty is divided by it too.

    Every iteration is a pass over the rows, so they are checkpointed first: the
    features are made once, and a lost executor does not make them again.
    """
    shared_dir(train.sparkSession)
    weighted = with_balanced_weights(train.select(label, features).checkpoint(), label)
    total = weighted.agg(F.sum("weight")).first()[0]
    if not total:
        raise ValueError("no training rows")
    return LogisticRegression(
        featuresCol=features, labelCol=label, weightCol="weight", regParam=1.0 / (c * total),
        elasticNetParam=0.0, standardization=False, maxIter=max_iterations, tol=tol,
        family="binomial").fit(weighted)


def hash_terms(df: DataFrame, keep: Sequence[str], text: str = "code", digits: int = 3,
               n: int = 2, hashing: str = "md5") -> DataFrame:
    """``keep`` columns plus ``counts``: how often tokens, and runs of ``n`` tokens, of each bucket occur
    (see ``vectors.bucket_counts``)."""
    grams = NGram(inputCol="tokens", outputCol="grams", n=n).transform(
        df.withColumn("tokens", text_tokens(F.col(text))))
    return bucket_counts(grams, "concat(tokens, grams)", keep, digits, hashing)


def stored_terms(df: DataFrame, keep: Sequence[str], text: str = "code") -> DataFrame:
    """``hash_terms``, checkpointed in the shared folder."""
    shared_dir(df.sparkSession)
    return hash_terms(df, keep, text).checkpoint()


def term_features(counts: str = "counts") -> Pipeline:
    """Estimator from ``counts`` to ``features``: weighted by rarity and brought to length 1."""
    return Pipeline(stages=[IDF(inputCol=counts, outputCol="rare"),
                            Normalizer(inputCol="rare", outputCol="features")])


def fit_terms_classifier(train: DataFrame, label: str = "label", tol: float = 1e-4, counts: str = "counts",
                         **settings) -> PipelineModel:
    """Counts of terms to two-class probabilities: rarity weights and a linear model."""
    stages = term_features(counts).fit(train)
    features = stages.transform(train).select(label, "features")
    return PipelineModel(stages.stages + [fit_classifier(features, label=label, tol=tol, **settings)])


def objective_gradient(model: LogisticRegressionModel, train: DataFrame, features: str = "features",
                       label: str = "label", c: float = 1.0) -> DataFrame:
    """``dim, gradient`` of the objective of ``fit_classifier`` at the fitted weights; all 0 at its minimum.

    The last dimension is the intercept, which has no penalty.
    """
    weights, intercept = [float(w) for w in model.coefficients], float(model.intercept)
    x = F.concat(vector_to_array(features), F.array(F.lit(1.0)))
    z = F.aggregate(F.zip_with(x, F.array(*[F.lit(w) for w in [*weights, intercept]]), lambda a, b: a * b),
                    F.lit(0.0), lambda a, b: a + b)
    error = F.col("weight") * (1 / (1 + F.exp(-F.col("z"))) - F.col(label))
    rows = with_balanced_weights(train.select(label, features), label).withColumn("z", z)
    summed = rows.select(F.posexplode(F.transform(x, lambda a: a * error)).alias("dim", "part"))
    own = F.element_at(F.array(*[F.lit(w) for w in [*weights, 0.0]]), F.col("dim") + 1)
    return summed.groupBy("dim").agg(F.sum("part").alias("loss")).select(
        "dim", (c * F.col("loss") + own).alias("gradient"))


def predict(model, df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns plus ``p0``, ``p1`` and the predicted class."""
    p = F.col("__p")
    return (model.transform(df).withColumn("__p", vector_to_array("probability"))
                 .select(*keep, p[0].alias("p0"), p[1].alias("p1"),
                         argmax2(p[0], p[1]).alias("y_pred")))


def check_weights(weights: Mapping[str, float]) -> None:
    if abs(sum(weights.values()) - 1.0) > 1e-6:
        raise ValueError("the weights of a blend must add up to 1")


def blend_scores(scores: DataFrame, weights: Mapping[str, float], policy: str = "fail",
                 id_col: str = "sample_id") -> DataFrame:
    """Weighted mean of the probabilities of several models, per sample.

    ``scores`` has ``id_col, model, p0, p1``; the models named in ``weights`` take
    part. A sample that a model scored twice stops the job; one that a model did
    not score stops it too (``fail``) or is left out (``drop``). Each sample has
    one row per model, so a group is as small as the number of models.
    """
    check_weights(weights)
    model = F.col("model")

    def weighted(p: str) -> Column:
        # One conditional sum per model, added in a fixed order: the same digits on every run.
        return reduce(lambda a, b: a + b, (
            F.max(F.when(model == m, F.col(p))) * F.lit(float(w)) for m, w in weights.items()))

    per_sample = scores.filter(model.isin(*weights)).groupBy(id_col).agg(
        weighted("p0").alias("p0"), weighted("p1").alias("p1"), F.count("*").alias("n"),
        *[F.count_if(model == m).alias(f"n_{i}") for i, m in enumerate(weights)])
    counts = [F.col(f"n_{i}") for i in range(len(weights))]
    twice = F.greatest(*counts, F.lit(0)) > 1
    missing = F.least(*counts, F.lit(1)) < 1
    message = F.concat(F.lit("scores are not one per model for sample "),
                       F.col(id_col).cast("string"))
    stop = F.raise_error(message).cast("boolean")
    keep = F.when(twice, stop).when(
        missing, stop if policy == "fail" else F.lit(False)).otherwise(F.lit(True))
    return per_sample.filter(keep).select(
        id_col, "p0", "p1", argmax2(F.col("p0"), F.col("p1")).alias("y_pred"))
