"""Combining the label sets of several models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelops.functions import labels as L
from labelops.vocab import NODES, sql_string


def label_votes(
    predictions: DataFrame, keys: Sequence[str] = ("id",), vocabulary: Sequence[str] = NODES
) -> DataFrame:
    """Number of models that predict each label, as an array per key.

    One shuffle on the key with a fixed number of counters, combined before
    it; a key without any label keeps a row of zeros. A label outside the
    vocabulary is an error and not dropped.
    """
    sets = predictions.select(*keys, L.label_bits("labels", vocabulary).alias("bits"))
    return sets.groupBy(*keys).agg(L.label_counts("bits", len(vocabulary)).alias("votes"))


def labels_with_votes(at_least: float, vocabulary: Sequence[str] = NODES) -> Column:
    """Labels whose votes reach a number."""
    return L.decode_array("votes", vocabulary, f"flag >= {float(at_least)!r}D")


def ensemble_by_union(
    predictions: DataFrame, keys: Sequence[str] = ("id",), vocabulary: Sequence[str] = NODES
) -> DataFrame:
    """Labels predicted by any model."""
    votes = label_votes(predictions, keys, vocabulary)
    return votes.select(*keys, labels_with_votes(1, vocabulary).alias("labels"))


def ensemble_by_vote(
    predictions: DataFrame,
    n_models: int,
    share: float = 0.5,
    keys: Sequence[str] = ("id",),
    vocabulary: Sequence[str] = NODES,
) -> DataFrame:
    """Labels predicted by at least a share of the models loaded."""
    votes = label_votes(predictions, keys, vocabulary)
    return votes.select(*keys, labels_with_votes(n_models * share, vocabulary).alias("labels"))


def both_ensembles(
    predictions: DataFrame, n_models: int, keys: Sequence[str] = ("id",), vocabulary: Sequence[str] = NODES
) -> DataFrame:
    """Union and vote from one aggregate: (keys, ensemble, labels)."""
    votes = label_votes(predictions, keys, vocabulary)
    kinds = F.array(
        F.struct(F.lit("union").alias("ensemble"), labels_with_votes(1, vocabulary).alias("labels")),
        F.struct(F.lit("vote").alias("ensemble"), labels_with_votes(n_models * 0.5, vocabulary).alias("labels")),
    )
    return votes.select(*keys, F.inline(kinds))


def aligned_models(
    predictions: DataFrame, models: Sequence[str], key: str = "id", vocabulary: Sequence[str] = NODES
) -> DataFrame:
    """One row per key with one label array per model, NULL where a model has none.

    The models stay one long table; a single aggregate of one BIGINT per model
    takes the place of a chain of joins. A model outside the list is an error.
    """
    refused = F.raise_error(F.concat(F.lit("model outside the list: "), F.coalesce("model", F.lit("NULL"))))
    listed = F.when(F.col("model").isin(*models), L.label_bits("labels", vocabulary)).otherwise(refused.cast("long"))
    sets = predictions.select(key, "model", listed.alias("bits"))
    wide = sets.groupBy(key).agg(
        *[F.expr(f"bit_or(if(model = {sql_string(m)}, bits, null))").alias(m) for m in models]
    )
    decoded = [F.when(F.col(f"`{m}`").isNotNull(), L.decode_bits(f"`{m}`", vocabulary)).alias(m) for m in models]
    return wide.select(key, *decoded)
