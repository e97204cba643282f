"""Evaluation of predictions. Each metric set is one aggregate over the predictions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def confusion(predictions: DataFrame, by: list[str] = [], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """tn, fp, fn, tp of 0/1 columns."""

    def cell(truth: int, guess: int) -> Column:
        return F.count_if((F.col(label) == truth) & (F.col(prediction) == guess))

    return predictions.groupBy(*by).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def metrics_from_confusion(cells: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and false-positive rate; a zero denominator gives 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return cells.select(
        "*", (tn + fp + fn + tp).alias("n"), _share(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        _share(tp, tp + fp).alias("precision"), _share(tp, tp + fn).alias("recall"),
        _share(2 * tp, 2 * tp + fp + fn).alias("f1"), _share(fp, fp + tn).alias("false_positive_rate"),
    )


def binary_metrics(predictions: DataFrame, by: list[str] = [], label: str = "label", prediction: str = "prediction") -> DataFrame:
    return metrics_from_confusion(confusion(predictions, by, label, prediction))


def fold_scores(predictions: DataFrame, fold: str = "fold") -> DataFrame:
    """Scores per fold plus their mean in the row where the fold is NULL."""
    per_fold = binary_metrics(predictions, by=[fold])
    return per_fold.rollup(fold).agg(*[F.avg(m).alias(m) for m in ("accuracy", "precision", "recall", "f1")])


def multiclass_confusion(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return predictions.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(predictions: DataFrame, classes: list, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Matrix form: one row per label, one column per predicted class."""
    return predictions.groupBy(label).pivot(prediction, classes).count().na.fill(0)


def multiclass_accuracy(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    hits, n = F.count_if(F.col(label) == F.col(prediction)), F.count(F.lit(1))
    return predictions.agg(hits.alias("correct"), n.alias("n"), _share(hits, n).alias("accuracy"))


def compare_models(predictions: DataFrame, model: str = "model", models: list[str] | None = None) -> DataFrame:
    """Metrics side by side: one row per metric, one column per model."""
    scores = binary_metrics(predictions, by=[model])
    long = scores.unpivot([model], ["accuracy", "precision", "recall", "f1"], "metric", "value")
    return long.groupBy("metric").pivot(model, models).agg(F.first("value"))


def class_share(df: DataFrame, target: str) -> DataFrame:
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def class_count(df: DataFrame, target: str) -> DataFrame:
    return df.agg(F.count_distinct(target).alias("classes"))
