"""Seeded sampling and class balancing."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from math import sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelops.functions import labels as L
from labelops.operators.ranges import global_rank
from labelops.operators.selection import Histogram, at_cut, below, bounded_counts, lowest, ranked_in_prefixes
from labelops.operators.stats import label_support
from labelops.vocab import LABELS, label_at, sql_string

# Sampling keys are the leading 12 hexadecimal digits of an MD5 sum.
KEY_SPACE = 16**12

Augment = Callable[[DataFrame], DataFrame]


def sampling_key(seed: int, *parts: Column | str) -> Column:
    """Pseudo-random BIGINT that depends on the seed and the parts only."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def _key_cut(wanted: int, available: int) -> int:
    """Key below which at least ``wanted`` of ``available`` rows are all but sure to fall."""
    if available <= 0:
        return KEY_SPACE
    generous = wanted + 8 * sqrt(wanted) + 16
    return min(KEY_SPACE, int(KEY_SPACE * generous / available) + 1)


def sample_exact(df: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """Exactly n rows without replacement: those with the lowest sampling keys.

    The n-th key is found from counts of key prefixes, and the rows are those up
    to it: nothing is ranked or sorted. The key cut leaves little more than n
    rows to be counted; should it leave too few, all rows are counted instead.
    Of rows that share the n-th id any fill what is missing.
    """
    available = df.count()
    if n >= available:
        return df
    identity = F.coalesce(F.col(key).cast("string"), F.lit(""))
    keyed = df.withColumn("sampling_key", sampling_key(seed, key))
    rows = keyed.select(F.lit(0).alias("group"), F.col("sampling_key").alias("key"), identity.alias("id"), F.lit(0).cast("long").alias("bits"))
    histogram = Histogram(rows.filter(F.col("key") < _key_cut(n, available)), 0)
    if histogram.support(0) < n:
        histogram = Histogram(rows, 0)
    cut = lowest(histogram, 0, n)
    sampled = keyed.filter(below(cut, F.col("sampling_key"), identity))
    if cut.copies < cut.all_copies:
        equal = keyed.filter(at_cut(cut, F.col("sampling_key"), identity))
        some = global_rank(equal, [F.col("sampling_key")], name="sample_rank").filter(F.col("sample_rank") <= cut.copies)
        sampled = sampled.unionByName(some.drop("sample_rank"))
    return sampled.drop("sampling_key")


def sample_with_replacement(df: DataFrame, m: int, seed: int, key: str = "id") -> DataFrame:
    """m independent draws: the rows of the table plus the number of the draw."""
    available = df.count()
    if available == 0:
        return df.withColumn("draw", F.lit(None).cast("long"))
    ordered = global_rank(
        df.withColumn("sampling_key", sampling_key(seed, key)), [F.col("sampling_key"), F.col(key)], name="draw_rank"
    ).drop("sampling_key")
    draws = df.sparkSession.range(m).select(
        F.col("id").alias("draw"), (sampling_key(seed, "id") % available + 1).alias("draw_rank")
    )
    return ordered.join(draws, "draw_rank").drop("draw_rank")


def label_shortfall(df: DataFrame, n: int, groups: Sequence[str] = ()) -> DataFrame:
    """How many rows each label lacks to reach n."""
    missing = F.greatest(F.lit(n).cast("long") - F.col("n"), F.lit(0).cast("long"))
    return label_support(df, groups).withColumn("shortfall", missing)


def synthetic_rows(draws: DataFrame, vocabulary: Sequence[str] = LABELS) -> DataFrame:
    """Rows for augmented texts: one target label, everything else a placeholder.

    ``draws`` holds (pos, draw, processed_text). Ids are built from label and
    draw, so they are unique by construction.
    """
    return draws.select(
        F.concat_ws("-", F.lit("aug"), F.col("pos"), F.col("draw")).alias("id"),
        F.lit("dummy").alias("text"),
        F.lit("dummy").alias("link"),
        F.array(label_at("pos", vocabulary)).alias("labels"),
        "processed_text",
    )


def _plan(histogram: Histogram, n: int, size: int) -> tuple[dict[int, int], dict[int, int]]:
    """How many rows each label takes and how many are made, the rarest label first.

    A label that lacks rows ends at n exactly: it takes what it lacks, or all it
    has and the rest is made. What it takes adds to the counts of the labels
    after it, known within bounds until the segments that matter are looked into.
    """
    support = [histogram.support(pos) for pos in range(size)]
    order = [pos for pos in sorted(range(size), key=lambda p: (support[p], p)) if support[pos]]

    def rule(pos: int, low: np.ndarray, high: np.ndarray):
        # Which of the two bounds gives the fewest rows is clear: more rows held, fewer lacking.
        fewest, most = (min(max(n - held, 0), support[pos]) for held in (int(high[pos]), int(low[pos])))

        def settle(least: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            for bounds, held in ((least, low), (upper, high)):
                bounds[pos] = max(n, int(held[pos]))
            return least, upper

        return fewest, most, settle

    decided = None
    while decided is None:
        decided = bounded_counts(histogram, order, rule)
    # The same steps once more, on exact counts.
    counts, take, make = np.zeros(size, np.int64), {}, {}
    for pos, taken in decided:
        missing = n - int(counts[pos])
        if missing <= 0:
            continue
        take[pos] = taken
        counts = counts + histogram.taken(pos, taken, taken)[0]
        if support[pos] < missing:
            make[pos] = missing - support[pos]
        counts[pos] = n
    return take, make


def balance(
    df: DataFrame, n: int, seed: int, augment: Augment | None = None, vocabulary: Sequence[str] = LABELS
) -> DataFrame:
    """Bring every label to at least n rows, the rarest label first.

    ``df`` holds id, text, link, labels and processed_text. A label with
    enough source rows is sampled for what is still missing; otherwise all its
    rows are added and the rest is made by ``augment`` from its texts. Rows
    chosen for several labels appear several times, and a label may end above
    n because rows carry several labels.

    Labels depend on each other in sequence, but only through a vector of
    counts. One aggregate counts label sets per label and key prefix; the loop
    over labels runs on it, and a second one tells the few rows apart that lie
    at the boundaries. The rows are then selected by their keys in one pass.
    """
    spark = df.sparkSession
    columns = ["id", "text", "link", "labels", "processed_text"]
    df = df.select(*columns)
    if not df.filter(F.col("id").startswith("aug-")).isEmpty():
        raise ValueError("ids starting with 'aug-' are reserved for augmented rows")
    size = len(vocabulary)
    held = ", ".join(f"if(array_contains(labels, {sql_string(v)}), {i}, null)" for i, v in enumerate(vocabulary))
    positions = F.expr(f"array_compact(array({held}))")
    keyed = df.withColumn("group", F.explode(positions)).withColumn("key", sampling_key(seed, "group", "id"))
    flags = keyed.select("group", "key", F.coalesce("id", F.lit("")).alias("id"), L.label_bits("labels", vocabulary).alias("bits"))
    histogram = Histogram(flags, size)
    take, make = _plan(histogram, n, size)

    cuts = {pos: histogram.cut(pos, k) for pos, k in take.items()}
    identity = F.coalesce("id", F.lit(""))
    chosen = F.lit(False)
    for pos, cut in cuts.items():
        chosen = chosen | ((F.col("group") == pos) & below(cut, F.col("key"), identity))
    originals = keyed.filter(chosen).select(*columns)
    partly = {pos: cut for pos, cut in cuts.items() if cut.copies < cut.all_copies}
    if partly:
        equal = F.lit(False)
        for pos, cut in partly.items():
            equal = equal | ((F.col("group") == pos) & at_cut(cut, F.col("key"), identity))
        ranked = global_rank(keyed.filter(equal), [F.col("key")], groups=["group"])
        quota = F.element_at(F.create_map(*[F.lit(v) for pos, cut in partly.items() for v in (pos, cut.copies)]), F.col("group"))
        originals = originals.unionByName(ranked.filter(F.col("rank") <= quota).select(*columns))
    if not make:
        return originals

    def draws(pos: int, wanted: int) -> DataFrame:
        number = F.col("id") + 1
        available = histogram.support(pos)
        pick = number if available >= wanted else sampling_key(seed, F.lit(f"draw-{pos}"), "id") % available + 1
        return spark.range(wanted).select(F.lit(pos).alias("pos"), number.alias("draw"), pick.alias("rank"))

    wanted = reduce(DataFrame.unionAll, [draws(p, k) for p, k in make.items()])
    sources = keyed.filter(F.col("group").isin(list(make))).select("group", "key", "id", "processed_text")
    ranked = ranked_in_prefixes(sources, histogram, list(make)).select(F.col("group").alias("pos"), "rank", "processed_text")
    made = synthetic_rows(ranked.join(wanted, ["pos", "rank"]), vocabulary)
    return originals.unionByName(augment(made) if augment else made)
