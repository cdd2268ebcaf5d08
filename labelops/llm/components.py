"""Connected components of an undirected graph, as DataFrame jobs.

Every round joins each node to its smallest neighbour and contracts the graph
to what is left; node keys must be spread like hashes, so that chains of ever
smaller neighbours stay short and the graph shrinks by a constant factor each
round. Nothing but a row count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelops.session import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); nulls, loops and repeats are ignored.

    All nodes of a component have the same root, one of its nodes. An empty
    table gives an empty table.
    """
    rest = stored(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    found = None
    while found is None or not rest.isEmpty():
        both = rest.select("a", "b").union(rest.select("b", "a"))
        nearest = stored(
            both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")),
            "parents",
        )
        found = nearest if found is None else _through(found, nearest)
        left = nearest.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = nearest.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        joined = rest.join(left, "a").join(right, "b").where("ra <> rb")
        rest = stored(joined.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    return found


def _through(found: DataFrame, nearest: DataFrame) -> DataFrame:
    step = nearest.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return stored(found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
