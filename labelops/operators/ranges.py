"""Order-dependent work over sorted runs instead of one window per group.

A window ordered by score or key puts a whole group into one task. Here the
rows are range partitioned on group *and* order, so that even a group with a
third of all rows spreads over many runs. The run number is stored with the
rows; each run is then windowed on its own and starts from the totals of the
runs before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelops.session import materialise


def into_runs(df: DataFrame, groups: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Range partition the rows and store the partition number as ``run``.

    The rows are materialised, so every reader sees the same run numbers.
    """
    ranged = df.repartitionByRange(*[F.col(g) for g in groups], *order)
    return materialise(ranged.withColumn("run", F.spark_partition_id()))


def run_offsets(runs: DataFrame, groups: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Per group and run: totals of the earlier runs and of the whole group.

    At most one row per run plus one per group, so its window is small. For
    each name the result holds ``<name>_before`` and ``<name>_total``.
    """
    totals = runs.groupBy(*groups, "run").agg(*[c.alias(name) for name, c in sums.items()])
    group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *groups,
        "run",
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_before") for n in sums],
        *[F.sum(n).over(group).alias(f"{n}_total") for n in sums],
    )


def global_rank(
    df: DataFrame, order: Sequence[Column], groups: Sequence[str] = (), name: str = "rank"
) -> DataFrame:
    """1-based rank over all rows (or per group), with no window over a whole group.

    Rows are numbered and stored first. The number breaks ties, so that even
    copies without end of the same key spread over several runs.
    """
    order = [*order, F.col("row_number")]
    runs = into_runs(materialise(df.withColumn("row_number", F.monotonically_increasing_id())), groups, order)
    offsets = run_offsets(runs, groups, {"rows": F.count(F.lit(1))}).drop("rows_total")
    in_run = Window.partitionBy(*groups, "run").orderBy(*order)
    return (
        runs.withColumn("row_in_run", F.row_number().over(in_run))
        .join(offsets, [*groups, "run"])
        .withColumn(name, F.col("rows_before") + F.col("row_in_run"))
        .drop("run", "row_in_run", "rows_before", "row_number")
    )
