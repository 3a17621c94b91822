"""Class probabilities from scores, as plain expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(x: Column, w: Column) -> Column:
    """Inner product of two numeric arrays of equal length."""
    products = F.zip_with(x, w, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def linear_probability(x: Column, weights: Sequence[float], intercept: float) -> Column:
    """P(class 1) of a linear classifier with known weights."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    return sigmoid(dot(x, w) + F.lit(float(intercept)))


def softmax(logits: Sequence[Column]) -> list[Column]:
    """Probabilities of a list of scores; the largest is taken off first so nothing overflows."""
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    exps = [F.exp(z - top) for z in logits]
    total = sum(exps[1:], exps[0])
    return [e / total for e in exps]


def argmax2(first: Column, second: Column) -> Column:
    """Class of the larger of two scores. A tie goes to class 0."""
    return F.when(second > first, F.lit(1)).otherwise(F.lit(0))
