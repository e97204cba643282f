"""Training, scoring and evaluation of classifiers with Spark ML."""

import time
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.base import Model
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.functions import rules
from trafficlens.functions.vectors import argmax
from trafficlens.operators import metrics, mlprep
from trafficlens.operators import normalize as N
from trafficlens.operators.ranking import seeded_rank

MIN_FEEDBACK = 5


def _estimator(kind: str, width: int, classes: int, weight: str | None, seed: int):
    if kind == "random_forest":
        estimator = RandomForestClassifier(numTrees=20, maxDepth=6, seed=seed)
    elif kind == "logistic_regression":
        estimator = LogisticRegression(maxIter=50, regParam=1e-4)
    elif kind == "perceptron":
        estimator = MultilayerPerceptronClassifier(layers=[width, 64, 32, classes], maxIter=50, seed=seed)
    else:
        raise ValueError(f"unknown model kind {kind!r}")
    return estimator.setWeightCol(weight) if weight else estimator


def _resampled(rows: DataFrame, weight: str, seed: int) -> DataFrame:
    """Rows kept with a chance in proportion to their weight, for learners that take no weights."""
    most = rows.agg(F.max(weight)).first()[0]
    return rows.filter(F.rand(seed) * F.lit(most) < F.col(weight)).drop(weight) if most else rows.drop(weight)


def as_vector(df: DataFrame, features: str = "features") -> DataFrame:
    """Turn an ARRAY<DOUBLE> column into the vector type of Spark ML; vectors stay as they are."""
    if df.schema[features].dataType.typeName() == "array":
        return df.withColumn(features, array_to_vector(F.col(features)))
    return df


def train(
    df: DataFrame, kind: str = "random_forest", label: str = "label", weight: str | None = None, classes: int = 2, seed: int = 42
) -> Model:
    """Fit a classifier on ``features``; the training rows are kept in memory or on disk while it iterates.

    The perceptron takes no weights: it learns from rows drawn in proportion to them.
    """
    rows = as_vector(df).select("features", F.col(label).cast("double").alias("label"), *([weight] if weight else []))
    if weight and kind == "perceptron":
        rows, weight = _resampled(rows, weight, seed), None
    rows = rows.persist()
    try:
        first = rows.select("features").head()
        if first is None:
            raise ValueError("no training rows")
        return _estimator(kind, len(first[0]), classes, weight, seed).fit(rows)
    finally:
        rows.unpersist()


def score(df: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Add ``confidence`` (probability of class 1) and the decision ``is_predicted_malicious``."""
    out = model.transform(as_vector(df))
    scored = out.withColumn("confidence", vector_to_array("probability")[1])
    decision = rules.is_malicious_score(F.col("confidence"), threshold)
    return scored.withColumn("is_predicted_malicious", decision).drop("rawPrediction", "probability", "prediction")


def classify(df: DataFrame, model: Model) -> DataFrame:
    """Add the most probable class as ``prediction``."""
    out = model.transform(as_vector(df)).withColumn("prediction", argmax(vector_to_array("probability")))
    return out.drop("rawPrediction", "probability")


def predicted_as(df: DataFrame, k: int) -> DataFrame:
    return df.filter(F.col("prediction") == k)


def evaluate(df: DataFrame, model: Model, label: str = "label") -> DataFrame:
    """One row of metrics on held-out rows, in one pass."""
    scored = score(df, model).select(F.col(label).cast("int").alias("label"), F.col("is_predicted_malicious").cast("int").alias("prediction"))
    return metrics.binary_metrics(scored)


def save_model(model: Model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(kind: str, path: str) -> Model:
    from pyspark.ml import classification as C

    loader = {
        "random_forest": C.RandomForestClassificationModel,
        "logistic_regression": C.LogisticRegressionModel,
        "perceptron": C.MultilayerPerceptronClassificationModel,
    }[kind]
    return loader.load(path)


def history_row(result: DataFrame, kind: str, training_type: str, dataset_size: int, training_time: float) -> DataFrame:
    """Metrics as a row of the training history."""
    now = F.current_timestamp()
    return result.select(
        F.unix_micros(now).alias("id"), now.alias("timestamp"), F.lit(kind).alias("model_type"),
        F.lit(training_type).alias("training_type"), F.lit(dataset_size).cast("bigint").alias("dataset_size"),
        "accuracy", "precision", "recall", F.col("f1").alias("f1_score"), "false_positive_rate",
        F.lit(training_time).cast("double").alias("training_time"),
    )


def distinct_rows(df: DataFrame, id_column: str) -> DataFrame:
    """One row of those that agree in everything but the id: the smallest id."""
    rest = [c for c in df.columns if c != id_column]
    return df.groupBy(*[F.col(f"`{c}`") for c in rest]).agg(F.min(F.col(f"`{id_column}`")).alias(id_column))


def training_job(
    df: DataFrame, id_column: str, kind: str = "random_forest", ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42
) -> tuple[Model, PipelineModel, DataFrame]:
    """Clean, split, prepare, train with reward weights and evaluate; returns model, preparation, history row."""
    target = N.pick_target(df)
    rows = N.binarise_target(N.infinite_to_null(distinct_rows(df, id_column)), target)
    split = mlprep.stratified_split(rows, id_column, target, *ratios, seed=seed).drop(id_column).persist()
    try:
        fit_rows = split.filter("split = 'train'").drop("split")
        preparation = mlprep.fit_preparation(fit_rows, target)
        prepared = mlprep.prepare(fit_rows, preparation).withColumn("weight", mlprep.reward_weight(F.col(target)))
        started = time.monotonic()
        model = train(prepared, kind, target, "weight", seed=seed)
        seconds = time.monotonic() - started
        held_out = mlprep.prepare(split.filter("split = 'test'").drop("split"), preparation)
        result = evaluate(held_out, model, target)
        row = history_row(result, kind, "initial", fit_rows.count(), seconds)
        # The one-row result is computed here, while its input is still cached.
        row = df.sparkSession.createDataFrame(row.collect(), row.schema)
    finally:
        split.unpersist()
    return model, preparation, row


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """Newest label and features per alert; feedback without an alert stands alone."""
    key = F.coalesce("alert_id", F.concat(F.lit("row:"), F.col("id").cast("string")))
    newest = F.max_by(F.struct("label", "feature_data"), F.struct("timestamp", "id"))
    return feedback.groupBy(key.alias("alert_key")).agg(newest.alias("f")).select("alert_key", "f.label", F.col("f.feature_data").alias("features"))


def retrain(
    base: DataFrame, feedback: DataFrame, kind: str = "random_forest", seed: int = 42
) -> tuple[Model, DataFrame] | None:
    """Fit again on base rows and feedback; None with fewer than five feedback rows.

    A fifth of the feedback is held out and scored.
    """
    rows = seeded_rank(latest_feedback(feedback), "alert_key", seed).persist()
    try:
        n = rows.count()
        if n < MIN_FEEDBACK:
            return None
        held = F.col("rank") <= -(-n // 5)
        learn = as_vector(base).select("features", "label").unionByName(
            as_vector(rows.filter(~held)).select("features", "label")
        )
        started = time.monotonic()
        model = train(learn, kind, seed=seed)
        seconds = time.monotonic() - started
        result = evaluate(rows.filter(held).select("features", "label"), model)
        row = history_row(result, kind, "retraining", n, seconds)
        return model, base.sparkSession.createDataFrame(row.collect(), row.schema)
    finally:
        rows.unpersist()


def cross_validate(
    df: DataFrame, id_column: str, label: str = "label", features: list[str] | None = None, folds: int = 5,
    kind: str = "random_forest", seed: int = 42,
) -> DataFrame:
    """Pooled predictions of a stratified k-fold run: id, fold, label, prediction.

    With ``features`` the columns are min-max scaled by the training folds only. Training happens here, scoring
    when the result is read.
    """
    dealt = mlprep.stratified_folds(df, id_column, label, folds, seed)
    parts = []
    for k in range(folds):
        learn, test = dealt.filter(F.col("fold") != k), dealt.filter(F.col("fold") == k)
        if features:
            vector = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
            test = mlprep.min_max_scale(test, features, fit_on=learn).withColumn("features", vector)
            learn = mlprep.min_max_scale(learn, features).withColumn("features", vector)
        model = train(learn, kind, label, seed=seed)
        parts.append(classify(test, model).select(id_column, "fold", F.col(label).cast("int").alias("label"), "prediction"))
    return reduce(DataFrame.unionByName, parts)
