"""Exact ROC AUC and average precision, ties included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelops.functions.scores import ratio
from labelops.operators.ranges import into_runs, run_offsets
from labelops.operators.reshape import melt_metrics, score_elements
from labelops.vocab import display_rank, label_at


def score_steps(scores: DataFrame, groups: Sequence[str] = ("model",), score: str = "scores") -> DataFrame:
    """One row per group, label and distinct score, from the highest score down.

    Columns: n_pos and n_neg at that score, cum_pos and cum_neg down to it,
    and the totals pos_total and neg_total of the label. Equal scores combine
    before the first shuffle; the running counts are built per sorted run, so
    no task holds all the scores of a label.
    """
    keys = [*groups, "pos"]
    distinct = (
        score_elements(scores, groups, score)
        .groupBy(*keys, "score")
        .agg(
            F.sum(F.col("y").cast("long")).alias("n_pos"),
            F.sum(1 - F.col("y").cast("long")).alias("n_neg"),
        )
    )
    downwards = F.col("score").desc()
    runs = into_runs(distinct, keys, [downwards])
    offsets = run_offsets(runs, keys, {"positives": F.sum("n_pos"), "negatives": F.sum("n_neg")})
    so_far = Window.partitionBy(*keys, "run").orderBy(downwards).rowsBetween(Window.unboundedPreceding, 0)
    return (
        runs.withColumn("run_pos", F.sum("n_pos").over(so_far))
        .withColumn("run_neg", F.sum("n_neg").over(so_far))
        .join(offsets, [*keys, "run"])
        .select(
            *keys,
            "score",
            "n_pos",
            "n_neg",
            (F.col("positives_before") + F.col("run_pos")).alias("cum_pos"),
            (F.col("negatives_before") + F.col("run_neg")).alias("cum_neg"),
            F.col("positives_total").alias("pos_total"),
            F.col("negatives_total").alias("neg_total"),
        )
    )


def label_curve_metrics(scores: DataFrame, groups: Sequence[str] = ("model",), score: str = "scores") -> DataFrame:
    """ROC AUC and average precision per group and label.

    ``roc_auc`` is NULL if a label has only one class, ``ap`` if it has no
    positive row.
    """
    steps = score_steps(scores, groups, score)
    pairs_won = F.sum(F.col("n_neg") * (F.col("cum_pos") - F.col("n_pos") / 2))
    precision_steps = F.sum(F.col("n_pos") * ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")))
    return steps.groupBy(*groups, "pos").agg(
        ratio(pairs_won, F.max("pos_total").cast("double") * F.max("neg_total")).alias("roc_auc"),
        ratio(precision_steps, F.max("pos_total")).alias("ap"),
        F.max("pos_total").alias("support"),
    )


def weighted_curve_metrics(scores: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """Both metrics averaged over the labels, weighted by their support."""
    return weigh_by_support(label_curve_metrics(scores, groups), groups)


def weigh_by_support(per_label: DataFrame, groups: Sequence[str]) -> DataFrame:
    support = F.sum("support")
    return per_label.groupBy(*groups).agg(
        ratio(F.sum(F.col("roc_auc") * F.col("support")), support).alias("roc_auc"),
        ratio(F.sum(F.col("ap") * F.col("support")), support).alias("ap"),
    )


def label_metric_table(scores: DataFrame, groups: Sequence[str] = ("model", "train_set", "split")) -> DataFrame:
    """Per-label metrics over runs, with the rank that puts labels in report order."""
    return label_curve_metrics(scores, groups).select(
        *groups,
        label_at("pos").alias("label"),
        "roc_auc",
        "ap",
        "support",
    ).withColumn("display_rank", display_rank("label"))


def melted_metric_table(table: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    return melt_metrics(table, [*groups, "label"], ["roc_auc", "ap"])
