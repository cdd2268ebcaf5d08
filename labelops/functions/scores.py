"""Expressions over model scores and counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The threshold grid has 50 cuts, 0.02 apart, starting at 0.
GRID_SIZE = 50
GRID_STEP = 0.02


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sigmoid(logit: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_column(logit).cast("double")))


def sigmoid_array(logits: Column | str) -> Column:
    return F.transform(_column(logits), sigmoid)


def binarise(score: Column | str, threshold: Column | float) -> Column:
    """1 where the score reaches the threshold; both compared as DOUBLE."""
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (_column(score).cast("double") >= threshold.cast("double")).cast("int")


def grid_value(index: Column) -> Column:
    """Cut at a grid position, as the double product index * 0.02."""
    return index.cast("double") * F.lit(GRID_STEP)


def grid_positions() -> Column:
    return F.sequence(F.lit(0), F.lit(GRID_SIZE - 1))


def grid_index(score: Column | str) -> Column:
    """Last grid position whose cut the score reaches, -1 if there is none, NULL for NULL.

    The estimate by division may be off by one, so it is corrected by
    comparing with the very doubles of the grid.
    """
    score = _column(score).cast("double")
    guess = F.least(F.greatest(F.floor(score * GRID_SIZE), F.lit(0)), F.lit(GRID_SIZE - 1)).cast("int")
    above = (guess < GRID_SIZE - 1) & (score >= grid_value(guess + 1))
    below = score < grid_value(guess)
    return F.when(score.isNull(), None).when(above, guess + 1).when(below, guess - 1).otherwise(guess)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as DOUBLE, NULL for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def f_beta(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    weight = F.lit(float(beta) ** 2)
    return F.try_divide((1 + weight) * precision * recall, weight * precision + recall)


def f1_from_counts(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 from counts, 0 where it is undefined."""
    return F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def cross_entropy(y: Column, probability: Column, epsilon: float = 1e-12) -> Column:
    p = F.least(F.greatest(probability.cast("double"), F.lit(epsilon)), F.lit(1.0 - epsilon))
    return F.when(y == 1, -F.log(p)).otherwise(-F.log(1 - p))


def cross_entropy_from_logit(y: Column, logit: Column) -> Column:
    """The same loss from a logit, stable for large values."""
    x = logit.cast("double")
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
