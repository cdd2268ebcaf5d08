"""Checks of annotation and prediction sets; each returns the violations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelops.functions import labels as L
from labelops.vocab import NODES


def malformed_records(df: DataFrame, column: str = "_corrupt_record") -> DataFrame:
    """Records that could not be parsed (read in permissive mode)."""
    return df.filter(F.col(column).isNotNull())


def missing_keys(df: DataFrame, required: Sequence[str] = ("id", "labels")) -> DataFrame:
    """Rows that lack a required key, with the names of the missing ones."""
    missing = F.array_compact(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in required]))
    return df.withColumn("missing", missing).filter(F.size("missing") > 0)


def unknown_labels(df: DataFrame, known: Sequence[str] = NODES, key: str = "id") -> DataFrame:
    """(key, label) of every label outside the hierarchy, in any record."""
    return df.select(key, F.explode(L.unknown_labels("labels", known)).alias("label"))


def id_differences(gold: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Ids on one side only: (key, problem) with problem missing or extra."""
    sides = gold.select(key, F.lit(1).alias("side")).unionAll(predictions.select(key, F.lit(2).alias("side")))
    seen = sides.groupBy(key).agg(F.bit_or("side").alias("seen"))
    problem = F.when(F.col("seen") == 1, F.lit("missing")).otherwise(F.lit("extra"))
    return seen.filter("seen < 3").select(key, problem.alias("problem"))


def require_same_ids(gold: DataFrame, predictions: DataFrame, key: str = "id") -> None:
    """Raise unless both sides hold the same ids; looks at one violation only."""
    first = id_differences(gold, predictions, key).first()
    if first is not None:
        raise ValueError(f"gold and predictions differ in their ids, e.g. {first[0]!r} is {first[1]}")


def same_keys(left: DataFrame, right: DataFrame, key: str = "id") -> bool:
    """Whether both key sets are equal."""
    return id_differences(left, right, key).isEmpty()


def last_record_wins(df: DataFrame, order: str = "record_no", key: str = "id") -> DataFrame:
    """One row per key, the one read last.

    The maximum combines before the shuffle, so a key with very many copies is
    no burden for a single task. Equal places in the order go to the largest
    content, so that the result never depends on chance.
    """
    others = [c for c in df.columns if c != key]
    last = F.max(F.struct(order, *[c for c in others if c != order])).alias("last")
    return df.groupBy(key).agg(last).select(key, *[F.col(f"last.`{c}`").alias(c) for c in others])


def misaligned_ids(predictions: DataFrame, n_models: int, key: str = "id") -> DataFrame:
    """Ids that not every model has."""
    return (
        predictions.groupBy(key)
        .agg(F.count_distinct("model").alias("n_models"))
        .filter(F.col("n_models") != n_models)
    )


def unused_ids(candidates: DataFrame, *used: DataFrame, key: str = "id") -> DataFrame:
    """Candidate ids that occur in none of the tables."""
    for table in used:
        candidates = candidates.join(table.select(key), key, "left_anti")
    return candidates
