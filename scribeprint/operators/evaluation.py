"""Confusion matrices, rates and class reports over tables of predictions.

Everything is one aggregation with partial sums before the shuffle, so neither
a large group nor a skewed one is ever held in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASS_NAMES = {0: "Human", 1: "AI"}


def _cell(actual: int, predicted: int) -> Column:
    return F.count_if((F.col("y_true") == actual) & (F.col("y_pred") == predicted))


def _cells() -> list[Column]:
    return [_cell(0, 0).alias("tn"), _cell(0, 1).alias("fp"),
            _cell(1, 0).alias("fn"), _cell(1, 1).alias("tp")]


def _ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole)


def _with_rates(cells: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return cells.withColumns({
        "accuracy": _ratio(tp + tn, tp + tn + fp + fn),
        "recall": _ratio(tp, tp + fn),
        "false_positive_rate": _ratio(fp, fp + tn),
        "false_negative_rate": _ratio(fn, fn + tp),
    })


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    """Two rows (actual class) by two columns (predicted class), also when a class is absent."""
    cells = predictions.agg(*_cells())
    return cells.select(F.explode(F.array(
        F.struct(F.lit(0).alias("actual"), F.col("tn").alias("predicted_human"),
                 F.col("fp").alias("predicted_ai")),
        F.struct(F.lit(1).alias("actual"), F.col("fn").alias("predicted_human"),
                 F.col("tp").alias("predicted_ai")))).alias("r")).select("r.*")


def binary_metrics(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The four cells, accuracy, recall, false positive and false negative rate per group.

    A rate with nothing to divide by is null.
    """
    return _with_rates(predictions.groupBy(*by).agg(*_cells()))


def metrics_by_group(predictions: DataFrame, groups: Sequence[Sequence[str]]) -> DataFrame:
    """``binary_metrics`` for several groupings at once, in one pass over the predictions.

    ``groups`` lists the column sets; an empty one is the total. Columns that
    do not belong to a row's grouping are null, and ``grouping_id`` tells a
    null made that way from one in the data.
    """
    columns = list(dict.fromkeys(c for g in groups for c in g))
    cells = predictions.groupingSets([list(g) for g in groups], *columns).agg(
        F.grouping_id(*columns).alias("grouping_id"), *_cells())
    return _with_rates(cells)


def as_percent(metrics: DataFrame, columns: Sequence[str] = (
        "accuracy", "recall", "false_positive_rate", "false_negative_rate")) -> DataFrame:
    """The rates as text with two decimals, for display. Halves go to the even digit."""
    return metrics.withColumns({
        c: F.when(F.col(c).isNotNull(), F.format_string("%.2f%%", F.bround(F.col(c) * 100, 2)))
        for c in columns})


def class_report(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages,
    for each group of ``by``.

    A zero denominator gives 0.
    """
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def scores(name: str, hit: Column, wrongly_in: Column, missed: Column) -> Column:
        precision = F.coalesce(_ratio(hit, hit + wrongly_in), F.lit(0.0))
        recall = F.coalesce(_ratio(hit, hit + missed), F.lit(0.0))
        f1 = F.coalesce(_ratio(hit * 2, hit * 2 + wrongly_in + missed), F.lit(0.0))
        return F.struct(F.lit(name).alias("name"), precision.alias("precision"),
                        recall.alias("recall"), f1.alias("f1"), (hit + missed).alias("support"))

    cells = predictions.groupBy(*by).agg(*_cells())
    classes = cells.select(
        *by, scores(CLASS_NAMES[0], tn, fn, fp).alias("a"),
        scores(CLASS_NAMES[1], tp, fp, fn).alias("b"),
        F.coalesce(_ratio(tn + tp, tn + tp + fn + fp), F.lit(0.0)).alias("accuracy"),
        (tn + tp + fn + fp).alias("n"))
    n = F.col("n")

    def average(name: str, combine) -> Column:
        return F.struct(F.lit(name).alias("name"), *[
            combine(F.col("a")[m], F.col("b")[m]).alias(m) for m in ("precision", "recall", "f1")],
            n.alias("support"))

    macro = average("macro avg", lambda x, y: (x + y) / 2)
    weighted = average("weighted avg", lambda x, y: F.coalesce(F.try_divide(
        x * F.col("a.support") + y * F.col("b.support"), n), F.lit(0.0)))
    none = F.lit(None).cast("double")
    accuracy = F.struct(F.lit("accuracy").alias("name"), none.alias("precision"),
                        none.alias("recall"), F.col("accuracy").alias("f1"), n.alias("support"))
    rows = F.array(F.col("a"), F.col("b"), accuracy, macro, weighted)
    return classes.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")
