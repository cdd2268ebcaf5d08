"""Label counts, shares, length distributions and correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelops.functions import labels as L
from labelops.operators.reshape import quoted
from labelops.vocab import LABELS, label_at


def support_wide(df: DataFrame, vocabulary: Sequence[str] = LABELS) -> DataFrame:
    """Column sums of a one-hot table: one row."""
    return df.agg(*[F.expr(f"sum(`{v}`)").alias(v) for v in vocabulary])


def label_support(df: DataFrame, groups: Sequence[str] = (), vocabulary: Sequence[str] = LABELS) -> DataFrame:
    """Support of every vocabulary label, zero included: (groups, pos, label, n).

    One counter per label in one aggregate: rows are never exploded, and what
    is shuffled is one row per task and group.
    """
    sets = df.select(*groups, L.label_bits("labels", vocabulary).alias("bits"))
    counts = sets.groupBy(*groups).agg(L.label_counts("bits", len(vocabulary)).alias("counts"))
    long = counts.select(*groups, F.posexplode("counts").alias("pos", "n"))
    return long.select(*groups, "pos", label_at("pos", vocabulary).alias("label"), "n")


def labels_per_split(df: DataFrame, split: str = "data_type") -> DataFrame:
    """Number of labels assigned in each split; a label counts once per row, as in the supports."""
    sets = df.select(split, L.label_bits("labels").alias("bits"))
    return sets.groupBy(split).agg(F.sum(F.bit_count("bits").cast("long")).alias("total"))


def split_label_counts(df: DataFrame, split: str = "data_type") -> DataFrame:
    """Count per split and label, for labels that occur."""
    return label_support(df, [split]).filter("n > 0").select(split, "label", "n")


def with_split_share(counts: DataFrame, split: str = "data_type") -> DataFrame:
    """Share and percent of each label within its split (a few rows per split)."""
    total = F.sum("n").over(Window.partitionBy(split))
    share = F.col("n").cast("double") / total
    return counts.withColumn("share", share).withColumn("percent", share * 100)


def with_group_total(counts: DataFrame, totals: DataFrame, key: str = "data_type") -> DataFrame:
    """Look up the total of each group; both sides are aggregates."""
    return counts.join(totals, key)


def compare_supports(df: DataFrame, split: str, values: Sequence[str]) -> DataFrame:
    """One row per label, one count column per split."""
    support = label_support(df, [split])
    return (
        support.groupBy("pos", "label").pivot(split, list(values)).agg(F.sum("n")).fillna(0, subset=list(values))
    )


def with_total_row(wide: DataFrame, values: Sequence[str], name: str = "Total") -> DataFrame:
    """The comparison plus a row of column totals."""
    sums = [F.sum(quoted(v)).alias(v) for v in values]
    return wide.rollup("label").agg(*sums).withColumn("label", F.coalesce("label", F.lit(name)))


def split_sizes(df: DataFrame, split: str = "data_type") -> DataFrame:
    """Rows per split and whole percent of all rows."""
    sizes = df.groupBy(split).agg(F.count(F.lit(1)).alias("n"))
    everything = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return sizes.withColumn("percent", F.round(F.col("n") * 100.0 / everything, 0))


def length_boxes(df: DataFrame, length: str = "word_count", groups: Sequence[str] = ("label",)) -> DataFrame:
    """Box plot figures per label: quartiles, whiskers at 1.5 IQR, outliers left out.

    Lengths are counted first; quartiles are then exact percentiles of that
    histogram, whose size depends on the distinct lengths and not on the rows.
    """
    histogram = df.groupBy(*groups, length).agg(F.count(F.lit(1)).alias("n"))
    quartiles = F.percentile(length, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    boxes = histogram.groupBy(*groups).agg(
        quartiles.alias("q"), F.sum("n").alias("n_rows"), F.collect_list(length).alias("lengths")
    )
    boxes = boxes.select(
        *groups, "n_rows", "lengths", F.expr("q[0]").alias("q1"), F.expr("q[1]").alias("median"), F.expr("q[2]").alias("q3")
    )
    return boxes.select(
        *groups,
        "n_rows",
        "q1",
        "median",
        "q3",
        F.expr("array_min(filter(lengths, l -> l >= q1 - 1.5D * (q3 - q1)))").alias("whisker_low"),
        F.expr("array_max(filter(lengths, l -> l <= q3 + 1.5D * (q3 - q1)))").alias("whisker_high"),
    )


def label_sets(df: DataFrame, vocabulary: Sequence[str] = LABELS) -> DataFrame:
    """Histogram of distinct label sets (label_bits, n): the pre-aggregate of pair counts."""
    return df.groupBy(L.label_bits("labels", vocabulary).alias("label_bits")).agg(F.count(F.lit(1)).alias("n"))


def label_correlation(df: DataFrame, vocabulary: Sequence[str] = LABELS, lower_only: bool = False) -> DataFrame:
    """Pearson correlation of the 0/1 label columns: (label_a, label_b, pearson).

    Rows are first counted per distinct label set, and pairs are formed within
    these sets only. Position -1 stands for the row itself, so that the same
    counts hold the supports and the number of rows. NULL where a label is
    constant.
    """
    size = len(vocabulary)
    held = " , ".join(f"if(label_bits & {1 << i}L != 0, {i}, null)" for i in range(size))
    sets = label_sets(df, vocabulary).select("n", F.expr(f"array_compact(array(-1, {held}))").alias("held"))
    # explode_outer: no filter on the never empty array is pushed below the count
    pairs = sets.select("n", "held", F.explode_outer("held").alias("a")).select(
        "n", "a", F.explode_outer("held").alias("b")
    )
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))
    packed = counts.agg(F.map_from_entries(F.collect_list(F.struct(F.struct("a", "b"), "n"))).alias("counts"))

    def count(a: str, b: str) -> str:
        return f"cast(coalesce(counts[named_struct('a', {a}, 'b', {b})], 0) as double)"

    cells = packed.select("counts", F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))).alias("cell")).selectExpr(
        "counts", f"cell div {size} as div_a", f"cell % {size} as pos_b"
    ).selectExpr("counts", "cast(div_a as int) as pos_a", "pos_b")
    if lower_only:
        cells = cells.filter("pos_a > pos_b")
    n = cells.selectExpr(
        "pos_a",
        "pos_b",
        f"{count('-1', '-1')} as n",
        f"{count('-1', 'pos_a')} as n_a",
        f"{count('-1', 'pos_b')} as n_b",
        f"{count('pos_a', 'pos_b')} as n_ab",
    )
    return n.select(
        label_at("pos_a", vocabulary).alias("label_a"),
        label_at("pos_b", vocabulary).alias("label_b"),
        F.expr("try_divide(n * n_ab - n_a * n_b, sqrt(n_a * (n - n_a) * n_b * (n - n_b)))").alias("pearson"),
    )


def label_links(gold: DataFrame, predicted: DataFrame, groups: Sequence[str] = (), key: str = "id") -> DataFrame:
    """How often a gold label meets a predicted label on the same row.

    Both sides keep one row per key for the join; the labels are exploded
    after it and counted with map-side combining.
    """
    both = gold.select(key, F.col("labels").alias("gold")).join(
        predicted.select(key, *groups, F.col("labels").alias("predicted")), key
    )
    return (
        both.select(*groups, F.explode("gold").alias("gold"), "predicted")
        .select(*groups, "gold", F.explode("predicted").alias("predicted"))
        .groupBy(*groups, "gold", "predicted")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def label_nodes(df: DataFrame) -> DataFrame:
    """Distinct labels in use, numbered from 0 in label order (a handful of rows)."""
    used = df.select(F.explode("labels").alias("label")).distinct()
    order = Window.partitionBy(F.lit(0)).orderBy("label")
    return used.select("label", (F.row_number().over(order) - 1).alias("node"))


def rank_labels(support: DataFrame, ascending: bool = False, groups: Sequence[str] = ()) -> DataFrame:
    """Rank the rows of a support table by count; ties go to the earlier label."""
    group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    by = F.col("n").asc() if ascending else F.col("n").desc()
    return support.withColumn("rank", F.row_number().over(group.orderBy(by, "pos")))


def reorder_like(support: DataFrame, reference: DataFrame) -> DataFrame:
    """A support table with the ranks of another one."""
    ranks = rank_labels(reference).select("label", "rank")
    return support.select("label", "n").join(ranks, "label")


def top_label(df: DataFrame) -> str:
    """Most frequent label; one value reaches the driver."""
    return label_support(df).orderBy(F.desc("n"), "pos").select("label").first()[0]


def balance_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Support and share of each label before and after balancing."""
    def shares(df: DataFrame, suffix: str) -> DataFrame:
        everything = F.sum("n").over(Window.partitionBy(F.lit(0)))
        return label_support(df).select(
            "label",
            F.col("n").alias(f"n_{suffix}"),
            F.try_divide(F.col("n").cast("double"), everything.cast("double")).alias(f"share_{suffix}"),
        )

    return shares(before, "before").join(shares(after, "after"), "label")

