"""A label hierarchy given as a table of edges instead of constants.

Nodes and all their ancestors are found by joins on the edges. For scoring, a
set of nodes is an array of BIGINTs, 64 nodes each, so hierarchies of more
nodes than one BIGINT holds need no shuffle of the labelled rows either.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelops.session import stored

#: The lookup table is read by every task, so its size is checked.
MAX_NODES = 4096


def ancestor_table(edges: DataFrame) -> DataFrame:
    """(node, ancestor) for every node of ``edges`` (parent, child), itself included.

    A null parent stands for the root, which is no node; rows without a child
    are ignored. Each round doubles the length of the paths followed, and a
    cycle ends like everything else when a round finds nothing new.
    """
    edges = edges.where("child is not null")
    steps = edges.where("parent is not null").select(F.col("child").alias("node"), F.col("parent").alias("ancestor"))
    nodes = edges.select(F.col("child").alias("node")).union(steps.select("ancestor"))
    reach = stored(steps.union(nodes.select("node", F.col("node").alias("ancestor"))).distinct(), "ancestors")
    before, rows = -1, reach.count()
    while rows > before:
        further = reach.select("node", F.col("ancestor").alias("via")).join(reach.withColumnRenamed("node", "via"), "via")
        reach = stored(further.select("node", "ancestor").distinct(), "ancestors")
        before, rows = rows, reach.count()
    return reach


def _with_lookup(df: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """``df`` with the table (node, value) as one map, read once per query; functions over arrays take it as a column."""
    return df.withColumn("__lookup", rows.agg(F.map_from_entries(F.collect_list(F.struct("node", value)))).scalar())


def _found(lookup: Column, label: Column, kind: str) -> Column:
    message = F.concat(F.lit("label outside the hierarchy: "), F.coalesce(label, F.lit("NULL")))
    return F.coalesce(F.element_at(lookup, F.coalesce(label, F.lit(""))), F.raise_error(message).cast(kind))


def node_words(ancestors: DataFrame) -> DataFrame:
    """(node, words): the closure of each node as bits, in the order of the names of all nodes."""
    nodes = ancestors.select("node").distinct()
    n = nodes.count()
    if n > MAX_NODES:
        raise ValueError(f"a hierarchy has up to {MAX_NODES} nodes, not {n}")
    # At most MAX_NODES rows.
    order = Window.partitionBy(F.lit(0)).orderBy("ancestor")
    places = nodes.select(F.col("node").alias("ancestor")).withColumn("at", F.row_number().over(order) - 1)
    bit = F.expr("shiftleft(1L, at % 64)")
    words = [F.coalesce(F.bit_or(F.when(F.expr(f"at div 64 = {w}"), bit)), F.lit(0).cast("long")) for w in range(-(-n // 64))]
    return ancestors.join(places, "ancestor").groupBy("node").agg((F.array(*words) if words else F.array().cast("array<long>")).alias("words"))


def with_label_words(df: DataFrame, masks: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Columns with the bits of labels and all their ancestors; an unknown label is an error.

    ``masks`` comes from ``node_words``; ``names`` gives each new column's column of labels.
    """
    lookup = F.col("__lookup")
    none = F.transform(F.get(F.map_values(lookup), F.lit(0)), lambda _: F.lit(0).cast("long"))

    def add(held: Column, label: Column) -> Column:
        return F.zip_with(held, _found(lookup, label, "array<long>"), lambda a, b: a.bitwiseOR(b))

    words = {name: F.aggregate(F.col(labels), none, add) for name, labels in names.items()}
    return _with_lookup(df, masks, "words").withColumns(words).drop("__lookup")


def with_ancestors(df: DataFrame, ancestors: DataFrame, labels: str = "labels", name: str = "nodes") -> DataFrame:
    """A column with the labels and all their ancestors as a sorted array; an unknown label is an error."""
    of_node = ancestors.groupBy("node").agg(F.collect_list("ancestor").alias("above"))
    nodes = F.flatten(F.transform(F.col(labels), lambda label: _found(F.col("__lookup"), label, "array<string>")))
    return _with_lookup(df, of_node, "above").withColumn(name, F.sort_array(F.array_distinct(nodes))).drop("__lookup")


def hierarchical_counts(aligned: DataFrame, masks: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Matched, predicted and gold nodes after adding all ancestors; three sums are shuffled."""
    sets = with_label_words(aligned, masks, {"g": "gold", "p": "predicted"})
    size = lambda bits: F.sum(F.aggregate(bits, F.lit(0).cast("long"), lambda n, b: n + F.bit_count(b)))
    return sets.groupBy(*groups).agg(
        size(F.zip_with("g", "p", lambda a, b: a.bitwiseAND(b))).alias("tp"),
        size(F.col("p")).alias("n_pred"),
        size(F.col("g")).alias("n_gold"),
    )
