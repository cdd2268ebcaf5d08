"""Wide, long and array forms of label data; typed alignment of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelops.functions import labels as L
from labelops.functions.text import clean_text
from labelops.vocab import LABELS, label_at, sql_string


def quoted(name: str) -> Column:
    """Column by its literal name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def one_hot_encode(df: DataFrame, labels: str = "labels", vocabulary: Sequence[str] = LABELS) -> DataFrame:
    """Replace the label array by one 0/1 column per vocabulary entry; an unknown label is an error."""
    rest = [f"`{c}`" for c in df.columns if c != labels]
    return df.withColumn(labels, L.known(labels, vocabulary)).selectExpr(*rest, *L.one_hot(labels, vocabulary))


def decode_wide(df: DataFrame, vocabulary: Sequence[str] = LABELS, name: str = "labels") -> DataFrame:
    """Replace the 0/1 columns by one label array in vocabulary order."""
    rest = [quoted(c) for c in df.columns if c not in vocabulary]
    return df.select(*rest, L.decode_columns(vocabulary).alias(name))


def label_vector(vocabulary: Sequence[str] = LABELS) -> Column:
    """0/1 columns packed into ARRAY<FLOAT>."""
    return F.expr("array(" + ", ".join(f"`{v}`" for v in vocabulary) + ")").cast("array<float>")


def select_labels(df: DataFrame, vocabulary: Sequence[str] = LABELS) -> DataFrame:
    """The label columns only, by name."""
    return df.select(*[quoted(v) for v in vocabulary])


def melt_labels(df: DataFrame, ids: Sequence[str], vocabulary: Sequence[str] = LABELS) -> DataFrame:
    """Long form (ids, label, value) without the zero cells."""
    long = df.unpivot([quoted(i) for i in ids], [quoted(v) for v in vocabulary], "label", "value")
    return long.filter(F.col("value") != 0)


def melt_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metric columns to (ids, variable, value)."""
    return df.unpivot([quoted(i) for i in ids], [quoted(m) for m in metrics], "variable", "value")


def explode_labels(df: DataFrame, labels: str = "labels", name: str = "label") -> DataFrame:
    """One row per label; a row without labels stays as one NULL row."""
    rest = [quoted(c) for c in df.columns if c != labels]
    return df.select(*rest, F.explode_outer(labels).alias(name))


def with_label(df: DataFrame, label: str, labels: str = "labels") -> DataFrame:
    """Rows that hold the label."""
    return df.filter(F.array_contains(F.col(labels), label))


def tag_splits(parts: Mapping[str, DataFrame], name: str = "data_type") -> DataFrame:
    """All rows of all parts, tagged with the name of their part."""
    tagged = [df.withColumn(name, F.lit(tag)) for tag, df in parts.items()]
    return union_all(tagged)


def tag_by_condition(df: DataFrame, conditions: Mapping[str, Column], name: str = "data_type") -> DataFrame:
    """All rows of one table, tagged with the first name whose condition holds, in one projection."""
    tags = [F.when(condition, F.lit(tag)) for tag, condition in conditions.items()]
    return df.withColumn(name, F.coalesce(*tags))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all parts, duplicates kept, columns matched by name."""
    first, *others = parts
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def fill_missing(df: DataFrame, values: Mapping[str, object] | int = 0) -> DataFrame:
    return df.fillna(dict(values) if isinstance(values, Mapping) else values)


def cast_like(df: DataFrame, model: DataFrame) -> DataFrame:
    """Columns and types of another table."""
    return df.select(*[quoted(f.name).cast(f.dataType).alias(f.name) for f in model.schema])


def with_clean_text(
    df: DataFrame, text: str = "text", name: str = "processed_text", keep_punctuation: bool = False
) -> DataFrame:
    """Add the cleaned text, computed once per row.

    The one-element array keeps a later filter on the result from being pushed
    below the projection, which would run the whole chain of patterns twice.
    """
    return df.withColumn(name, F.explode_outer(F.array(clean_text(text, keep_punctuation))))


def drop_empty_text(df: DataFrame, text: str = "processed_text") -> DataFrame:
    return df.filter(F.col(text) != "")


def model_input(df: DataFrame, text: str = "processed_text", vocabulary: Sequence[str] = LABELS) -> DataFrame:
    """What a classifier needs: id, text and label vector."""
    return df.select("id", F.col(text).alias("text"), label_vector(vocabulary).alias("labels"))


def join_encoded(df: DataFrame, encoded: DataFrame, key: str = "id") -> DataFrame:
    """Features left-joined with their label columns."""
    return df.join(encoded, key, "left")


def score_elements(scores: DataFrame, keep: Sequence[str] = ("model",), score: str = "scores") -> DataFrame:
    """Score arrays to (keep, pos, y, score), one row per label; no shuffle.

    The outer form is filtered after it, since the plain one would compute the
    array once more to drop empty ones before.
    """
    cells = scores.select(*keep, "y", F.posexplode_outer(score).alias("pos", "score"))
    return cells.filter("pos is not null").select(*keep, "pos", F.col("y")[F.col("pos")].alias("y"), "score")


def long_scores(scores: DataFrame) -> DataFrame:
    """Score arrays to (id, model, label, y, score)."""
    return score_elements(scores, ("id", "model")).withColumn("label", label_at("pos"))


def wide_scores(long: DataFrame, vocabulary: Sequence[str] = LABELS, keys: Sequence[str] = ("id", "model")) -> DataFrame:
    """Long scores (keys, label, y, score) to one row of arrays per key.

    One fixed-width aggregate buffer per key, so a repeated key combines
    before the shuffle.
    """

    def cells(column: str) -> Column:
        picked = [f"max(if(label = {sql_string(v)}, {column}, null))" for v in vocabulary]
        return F.expr("array(" + ", ".join(picked) + ")")

    return long.groupBy(*keys).agg(cells("y").alias("y"), cells("score").alias("scores"))
