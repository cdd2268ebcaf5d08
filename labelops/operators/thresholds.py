"""Decision thresholds: applying them, and searching them in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelops.functions import labels as L
from labelops.functions.scores import (
    GRID_SIZE,
    binarise,
    f1_from_counts,
    grid_index,
    grid_positions,
    grid_value,
    ratio,
)
from labelops.operators.reshape import score_elements
from labelops.vocab import LABELS, label_at, sql_string


def apply_thresholds(
    scores: DataFrame, thresholds: DataFrame, vocabulary: Sequence[str] = LABELS, keys: Sequence[str] = ("model",)
) -> DataFrame:
    """Add ``yhat`` (0/1 array) and ``labels`` from cut-offs (keys, label, threshold).

    Cut-offs are matched by label name. They are gathered into one row per
    model, so the scores keep one row per id. Rows of a model without cut-offs,
    and a vocabulary label without one, are an error.
    """
    entries = F.collect_set(F.struct("label", "threshold"))
    by_model = thresholds.groupBy(*keys).agg(F.map_from_entries(entries).alias("cut"))
    by_position = ", ".join(f"cut[{sql_string(v)}]" for v in vocabulary)
    run = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    refusal = lambda text: F.raise_error(F.concat(F.lit(text), run)).cast("array<double>")
    cuts = by_model.withColumn("cuts", F.expr(f"array({by_position})").cast("array<double>"))
    lacking = F.exists("cuts", lambda cut: cut.isNull())
    cuts = cuts.select(*keys, F.when(lacking, refusal("a label has no cut-off: ")).otherwise(F.col("cuts")).alias("cuts"))
    return (
        scores.join(cuts, list(keys), "left")
        .withColumn("cuts", F.coalesce("cuts", refusal("no cut-offs: ")))
        .withColumn("yhat", F.zip_with("scores", "cuts", binarise))
        .drop("cuts")
        .withColumn("labels", L.decode_array("yhat", vocabulary))
    )


def apply_threshold(scores: DataFrame, threshold: float, vocabulary: Sequence[str] = LABELS) -> DataFrame:
    """The same with one cut-off for all labels."""
    flagged = scores.withColumn("yhat", F.transform("scores", lambda score: binarise(score, threshold)))
    return flagged.withColumn("labels", L.decode_array("yhat", vocabulary))


def grid_counts(scores: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """Confusion counts of every label at all 50 cuts, from one pass.

    Scores fall into the 51 bins between the cuts, which combine before the
    shuffle; only that histogram is then spread over the grid.
    """
    keys = [*groups, "pos"]
    histogram = (
        score_elements(scores, groups)
        .groupBy(*keys, grid_index("score").alias("bin"))
        .agg(F.sum(F.col("y").cast("long")).alias("n_pos"), F.count(F.lit(1)).alias("n"))
    )
    reached = F.col("bin") >= F.col("cut")
    return (
        histogram.withColumn("cut", F.explode(grid_positions()))
        .groupBy(*keys, "cut")
        .agg(
            F.sum(F.when(reached, F.col("n_pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(reached, F.col("n") - F.col("n_pos")).otherwise(0)).alias("fp"),
            F.sum("n_pos").alias("n_pos"),
            F.sum("n").alias("n"),
        )
        .withColumn("fn", F.col("n_pos") - F.col("tp"))
        .withColumn("tn", F.col("n") - F.col("n_pos") - F.col("fp"))
        .withColumn("threshold", grid_value(F.col("cut")))
    )


def sweep_f1(scores: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """Support-weighted F1 at each cut of the grid."""
    f1 = f1_from_counts(F.col("tp"), F.col("fp"), F.col("fn"))
    return (
        grid_counts(scores, groups)
        .groupBy(*groups, "cut", "threshold")
        .agg(ratio(F.sum(f1 * F.col("n_pos")), F.sum("n_pos")).alias("f1"))
    )


def _right_span(scores: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Grid positions between which a row has all labels right: (above, upto].

    A row is right at a cut above its best negative score and not above its
    worst positive one.
    """
    negative = F.array_max(F.zip_with("y", "scores", lambda y, s: F.when(y == 0, s)))
    positive = F.array_min(F.zip_with("y", "scores", lambda y, s: F.when(y == 1, s)))
    edges = scores.select(*keep, negative.alias("best_negative"), positive.alias("worst_positive"))
    return edges.select(
        *keep,
        F.coalesce(grid_index("best_negative"), F.lit(-1)).alias("above"),
        F.coalesce(grid_index("worst_positive"), F.lit(GRID_SIZE - 1)).alias("upto"),
    )


def sweep_accuracy(scores: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """Share of rows with all labels right, at each cut of the grid."""
    spans = _right_span(scores, groups).groupBy(*groups, "above", "upto").agg(F.count(F.lit(1)).alias("n"))
    right = (F.col("cut") > F.col("above")) & (F.col("cut") <= F.col("upto"))
    return (
        spans.withColumn("cut", F.explode(grid_positions()))
        .groupBy(*groups, "cut")
        .agg(ratio(F.sum(F.when(right, F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))
        .withColumn("threshold", grid_value(F.col("cut")))
    )


def threshold_sweep(scores: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """Weighted F1 and subset accuracy at each cut, from one pass over the scores.

    Besides one cell per label (its bin and its truth) each row gives one cell
    for itself (its right span); both kinds share the histogram. The row's own
    cell is the one without a score, at the position after the last label.
    """
    rows = _right_span(scores, [*groups, "y", "scores"])
    cells = rows.select(
        *groups,
        "y",
        "above",
        "upto",
        F.posexplode_outer(F.concat("scores", F.array(F.lit(None).cast("double")))).alias("pos", "score"),
    )
    of_row = F.col("pos") == F.size("y")
    histogram = (
        cells.select(
            *groups,
            F.when(of_row, -1).otherwise(F.col("pos")).alias("pos"),
            F.when(of_row, F.col("above")).otherwise(grid_index("score")).alias("low"),
            F.when(of_row, F.col("upto")).otherwise(F.col("y")[F.col("pos")]).alias("high"),
        )
        .groupBy(*groups, "pos", "low", "high")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    n, high = F.col("n"), F.col("high")
    reached = F.col("low") >= F.col("cut")
    right = (F.col("low") < F.col("cut")) & (high >= F.col("cut"))
    total = lambda condition: F.sum(F.when(condition, n).otherwise(0))
    counts = (
        histogram.withColumn("cut", F.explode(grid_positions()))
        .groupBy(*groups, "pos", "cut")
        .agg(
            total(reached & (high == 1)).alias("tp"),
            total(reached & (high == 0)).alias("fp"),
            total(high == 1).alias("n_pos"),
            total(right).alias("n_right"),
            F.sum("n").alias("n"),
        )
    )
    label = F.col("pos") >= 0
    f1 = f1_from_counts(F.col("tp"), F.col("fp"), F.col("n_pos") - F.col("tp"))
    return (
        counts.groupBy(*groups, "cut")
        .agg(
            ratio(F.sum(F.when(label, f1 * F.col("n_pos"))), F.sum(F.when(label, F.col("n_pos")))).alias("f1"),
            ratio(F.sum(F.when(~label, F.col("n_right"))), F.sum(F.when(~label, n))).alias("accuracy"),
        )
        .withColumn("threshold", grid_value(F.col("cut")))
    )


def sweep_maxima(scores: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """Best F1 and best accuracy over the grid, each at its own cut."""
    return threshold_sweep(scores, groups).groupBy(*groups).agg(
        F.max("f1").alias("max_f1"), F.max("accuracy").alias("max_accuracy")
    )


def first_best_cut(sweep: DataFrame, groups: Sequence[str] = ("model",), metric: str = "f1") -> DataFrame:
    """The lowest cut that reaches the best value of a sweep (50 rows per group)."""
    order = Window.partitionBy(*groups).orderBy(F.col(metric).desc(), "cut")
    return sweep.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def label_threshold_scores(scores: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """F1 of both classes of each label, weighted by class support, at each cut."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    positive = F.col("n_pos") * f1_from_counts(tp, fp, fn)
    negative = (F.col("n") - F.col("n_pos")) * f1_from_counts(tn, fn, fp)
    return grid_counts(scores, groups).withColumn("f1", (positive + negative) / F.col("n"))


def best_label_thresholds(scores: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """Cut with the best F1 for each label; equal scores go to the lowest cut."""
    best = F.max(F.struct("f1", (-F.col("cut")).alias("lowest")))
    return (
        label_threshold_scores(scores, groups)
        .groupBy(*groups, "pos")
        .agg(best.alias("best"))
        .select(
            *groups,
            label_at("pos").alias("label"),
            grid_value(-F.col("best.lowest")).alias("threshold"),
            F.col("best.f1").alias("f1"),
        )
    )
