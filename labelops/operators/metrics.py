"""Metrics of predicted label sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelops.functions import labels as L
from labelops.operators import hierarchy
from labelops.functions.scores import cross_entropy, f1_from_counts, f_beta, ratio
from labelops.operators.reshape import score_elements
from labelops.operators.stats import top_label


def label_confusion(predictions: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """tp, fp and fn per group and label from the 0/1 arrays ``y`` and ``yhat``."""
    y, yhat = F.col("y").cast("long"), F.col("score").cast("long")
    return (
        score_elements(predictions, groups, "yhat")
        .groupBy(*groups, "pos")
        .agg(
            F.sum(y * yhat).alias("tp"),
            F.sum((1 - y) * yhat).alias("fp"),
            F.sum(y * (1 - yhat)).alias("fn"),
        )
    )


def weighted_f1(predictions: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """F1 of the labels, weighted by support; an undefined F1 counts as 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        label_confusion(predictions, groups)
        .groupBy(*groups)
        .agg(ratio(F.sum(f1_from_counts(tp, fp, fn) * (tp + fn)), F.sum(tp + fn)).alias("f1"))
    )


def label_f_beta(predictions: DataFrame, beta: float = 1.0, groups: Sequence[str] = ("model",)) -> DataFrame:
    """Precision, recall and F-beta of each label, NULL where undefined."""
    counts = label_confusion(predictions, groups)
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select(
        *groups,
        "pos",
        precision.alias("precision"),
        recall.alias("recall"),
        f_beta(precision, recall, beta).alias("f_beta"),
    )


def subset_accuracy(predictions: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """Share of rows whose labels are all right."""
    return predictions.groupBy(*groups).agg(
        F.avg((F.col("y") == F.col("yhat")).cast("double")).alias("accuracy")
    )


def mean_cross_entropy(scores: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """Binary cross-entropy averaged over rows and labels."""
    loss = cross_entropy(F.col("y"), F.col("score"))
    return score_elements(scores, groups).groupBy(*groups).agg(F.avg(loss).alias("loss"))


def hierarchical_counts(aligned: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Matched, predicted and gold nodes after adding all ancestors.

    ``aligned`` has the label arrays ``gold`` and ``predicted``. Each row is
    reduced to two bit sets, so only three sums are shuffled.
    """
    sets = aligned.select(
        *groups, L.node_bits("gold").alias("g"), L.node_bits("predicted").alias("p")
    )
    size = lambda bits: F.sum(F.bit_count(bits).cast("long"))
    return sets.groupBy(*groups).agg(
        size(F.col("g").bitwiseAND(F.col("p"))).alias("tp"),
        size(F.col("p")).alias("n_pred"),
        size(F.col("g")).alias("n_gold"),
    )


def hierarchical_scores(aligned: DataFrame, groups: Sequence[str] = (), masks: DataFrame | None = None) -> DataFrame:
    """Hierarchical precision, recall and F1 over all rows of a group.

    ``masks`` from ``hierarchy.node_words`` puts another hierarchy in place of
    the built-in one.
    """
    counts = hierarchical_counts(aligned, groups) if masks is None else hierarchy.hierarchical_counts(aligned, masks, groups)
    precision = ratio(F.col("tp"), F.col("n_pred"))
    recall = ratio(F.col("tp"), F.col("n_gold"))
    return counts.select(
        *groups,
        "tp",
        "n_pred",
        "n_gold",
        f_beta(precision, recall).alias("f1_h"),
        precision.alias("prec_h"),
        recall.alias("rec_h"),
    )


def align(
    gold: DataFrame, predictions: DataFrame, key: str = "id", run: Sequence[str] = (), n_runs: int = 1
) -> DataFrame:
    """Gold and predicted labels of the same key on one row.

    Both sides must hold the same keys: gold once, the predictions once for
    each of ``n_runs`` runs, which the columns ``run`` tell apart. A key that
    lacks on either side or in a run, one without labels, and a repeated one
    are errors (``validate.last_record_wins`` settles repeats beforehand).
    They are found after the join, on its own partitions and without a job.
    """
    both = gold.select(key, F.col("labels").alias("gold")).join(
        predictions.withColumnRenamed("labels", "predicted"), key, "full"
    )
    own = Window.partitionBy(key)
    problem = (
        F.when(F.col("gold").isNull(), F.lit("not in gold, or without labels there"))
        .when(F.col("predicted").isNull(), F.lit("not predicted, or without labels there"))
        .when(F.count(F.lit(1)).over(own) != n_runs, F.lit(f"not there once for each of {n_runs} runs"))
    )
    if run:
        this = F.struct(*run)
        problem = F.coalesce(problem, F.when(F.lag(this).over(own.orderBy(*run)) == this, F.lit("repeated in a run")))
    told = both.withColumn("__problem", problem)
    name = F.coalesce(F.col(key).cast("string"), F.lit("NULL"))
    error = F.raise_error(F.concat(F.lit("id "), name, F.lit(" is "), F.col("__problem"))).cast("array<string>")
    return told.withColumn(
        "predicted", F.when(F.col("__problem").isNull(), F.col("predicted")).otherwise(error)
    ).drop("__problem")


def binary_scores(df: DataFrame, classes: Sequence[str], gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Macro and micro F1 of single labels; one pass, one row. A class outside the list is an error."""
    def listed(column: str) -> Column:
        name = F.coalesce(F.col(column).cast("string"), F.lit("NULL"))
        error = F.raise_error(F.concat(F.lit("class outside the list: "), name)).cast(df.schema[column].dataType)
        return F.when(F.col(column).isin(*classes), F.col(column)).otherwise(error).alias(column)

    df = df.select(listed(gold), listed(predicted))
    g, p = F.col(gold), F.col(predicted)
    count = lambda condition: F.sum(condition.cast("long"))
    counts = df.agg(
        *[
            F.struct(
                count((g == c) & (p == c)).alias("tp"),
                count((g != c) & (p == c)).alias("fp"),
                count((g == c) & (p != c)).alias("fn"),
            ).alias(f"c{i}")
            for i, c in enumerate(classes)
        ]
    )
    names = [f"c{i}" for i in range(len(classes))]
    per_class = [f1_from_counts(F.col(f"{n}.tp"), F.col(f"{n}.fp"), F.col(f"{n}.fn")) for n in names]
    pooled = [sum((F.col(f"{n}.{k}") for n in names), F.lit(0)) for k in ("tp", "fp", "fn")]
    return counts.select(
        (sum(per_class, F.lit(0.0)) / len(classes)).alias("macro_f1"),
        f1_from_counts(*pooled).alias("micro_f1"),
    )


def majority_predictions(df: DataFrame, label: str | None = None, key: str = "id") -> DataFrame:
    """Baseline that gives every row the same label, by default the most frequent one."""
    label = top_label(df) if label is None else label
    return df.select(key, F.array(F.lit(label)).alias("labels"))


def best_run(runs: DataFrame, metric: str = "ap", groups: Sequence[str] = ()) -> DataFrame:
    """The run with the highest metric, per group if groups are given.

    Equal metrics go to the run that comes first by its other columns; runs
    with a NULL or NaN metric come last.
    """
    others = [c for c in runs.columns if c not in groups]
    unknown = F.col(metric).isNull() | F.isnan(metric)
    best = F.min(F.struct(unknown.alias("__unknown"), (-F.col(metric)).alias("__metric"), *others)).alias("best")
    return runs.groupBy(*groups).agg(best).select(*groups, *[F.col(f"best.`{c}`").alias(c) for c in others])
