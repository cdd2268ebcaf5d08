"""Which rows hold the lowest sampling keys, found from counts per key prefix.

Keys are uniform integers. Counts per prefix are small whatever the number of
rows; only prefixes in which a boundary falls are looked into, at twelve more
bits each time, and rows are told apart (by key, then id) once few are left. No
row is ranked, sorted or stored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY_BITS = 48
STEP_BITS = 12
#: Distinct rows that may be told apart on the driver at once.
FEW = 200_000


@dataclass(frozen=True)
class Cut:
    """The last row that is taken: all lower ones are, and ``copies`` of the rows equal to it."""

    key: int
    id: str
    copies: int
    all_copies: int


NOTHING = Cut(-1, "", 0, 0)
EVERYTHING = Cut(1 << KEY_BITS, "", 0, 0)


@dataclass(eq=False)
class Segment:
    """Rows of one group that follow each other: a key prefix of so many bits, or equal rows."""

    prefix: int
    bits: int
    rows: int
    sums: np.ndarray
    id: str | None = None


class Histogram:
    """Rows per key prefix of several groups, each with sums of its rows' flags.

    ``rows`` has group, key, id and bits; sums count each of ``size`` bits.
    """

    def __init__(self, rows: DataFrame, size: int):
        self.rows, self.size = rows, size
        counts = self._counted(rows, STEP_BITS)
        self.segments: dict[int, list[Segment]] = {}
        for row in counts.collect():
            self.segments.setdefault(row["group"], []).append(self._segment(row, STEP_BITS))
        self._sort()
        #: Rows before each prefix of the first step, for ranks.
        self.first_step = {g: [(s.prefix, s.rows) for s in found] for g, found in self.segments.items()}

    def _counted(self, rows: DataFrame, bits: int) -> DataFrame:
        prefix = F.shiftright("key", KEY_BITS - bits).alias("prefix")
        sums = F.array(*[F.count_if(F.col("bits").bitwiseAND(F.lit(1 << i)) != 0) for i in range(self.size)])
        return rows.groupBy("group", prefix).agg(F.count(F.lit(1)).alias("rows"), sums.alias("sums"))

    def _segment(self, row, bits: int) -> Segment:
        return Segment(row["prefix"], bits, row["rows"], np.array(row["sums"], dtype=np.int64))

    def _sort(self) -> None:
        for found in self.segments.values():
            found.sort(key=lambda s: (s.prefix << (KEY_BITS - s.bits), s.id or ""))

    def support(self, group: int) -> int:
        return sum(s.rows for s in self.segments.get(group, ()))

    def taken(self, group: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, list[Segment]]:
        """Bounds of the sums of the lowest rows, if at least ``low`` and at most ``high`` are taken.

        The segments are those to look into before the sums can be exact.
        """
        least, most, before, open_ = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64), 0, []
        for segment in self.segments.get(group, ()):
            if before >= high:
                break
            after = before + segment.rows
            if after <= low:
                least += segment.sums
                most += segment.sums
            elif segment.id is not None:
                # Equal rows: any part of them has the same flags.
                least += (max(low - before, 0) * segment.sums) // segment.rows
                most += (min(high - before, segment.rows) * segment.sums) // segment.rows
            else:
                most += segment.sums
                if before < high and not (low == high == after):
                    open_.append(segment)
            before = after
        return least, most, open_

    def look_into(self, wanted: Sequence[tuple[int, Segment]]) -> None:
        """Replace segments by finer ones, or by their rows where these are few."""
        inside = None
        for group, segment in wanted:
            shift = KEY_BITS - segment.bits
            low, high = segment.prefix << shift, (segment.prefix + 1) << shift
            here = (F.col("group") == group) & (F.col("key") >= low) & (F.col("key") < high)
            inside = here if inside is None else inside | here
        rows = self.rows.where(inside)
        bits = wanted[0][1].bits + STEP_BITS
        by_row = bits > KEY_BITS or sum(s.rows for _, s in wanted) <= FEW
        for group, segment in wanted:
            self.segments[group].remove(segment)
        if by_row:
            for row in rows.groupBy("group", "key", "id", "bits").agg(F.count(F.lit(1)).alias("rows")).collect():
                flags = np.array([row["bits"] >> i & 1 for i in range(self.size)], dtype=np.int64)
                self.segments[row["group"]].append(Segment(row["key"], KEY_BITS, row["rows"], flags * row["rows"], row["id"] or ""))
        else:
            for row in self._counted(rows, bits).collect():
                self.segments[row["group"]].append(self._segment(row, bits))
        self._sort()

    def cut(self, group: int, n: int) -> Cut:
        """Where the lowest n rows end; all segments there must have been looked into."""
        before = 0
        if n <= 0:
            return NOTHING
        for segment in self.segments.get(group, ()):
            if before + segment.rows >= n:
                if segment.id is None:
                    # The prefix ends with the last row.
                    return Cut((segment.prefix + 1) << (KEY_BITS - segment.bits), "", 0, 0)
                return Cut(segment.prefix, segment.id, n - before, segment.rows)
            before += segment.rows
        return EVERYTHING


def lowest(histogram: Histogram, group: int, n: int) -> Cut:
    """The cut of one group's lowest n rows."""
    while True:
        _, _, open_ = histogram.taken(group, n, n)
        if not open_:
            return histogram.cut(group, n)
        histogram.look_into([(group, s) for s in _same_depth(open_)])


def _same_depth(segments: list[Segment]) -> list[Segment]:
    depth = min(s.bits for s in segments)
    return [s for s in segments if s.bits == depth]


def below(cut: Cut, key: Column, id: Column) -> Column:
    """Whether a row is taken whatever its copies: it lies before the cut, or all copies there are taken."""
    at = F.lit(cut.copies == cut.all_copies) & (id == cut.id)
    return (key < cut.key) | ((key == cut.key) & ((id < cut.id) | at))


def at_cut(cut: Cut, key: Column, id: Column) -> Column:
    """Whether a row is one of the equal ones of which only some are taken."""
    return F.lit(cut.copies < cut.all_copies) & (key == cut.key) & (id == cut.id)


def bounded_counts(histogram: Histogram, order: Sequence[int], rule: Callable) -> list[tuple[int, int]] | None:
    """Let ``rule`` decide group by group how many rows are taken, from counts known exactly or within bounds.

    ``rule(group, low, high)`` is given bounds of all counts and returns those
    of the rows taken, and the new bounds given the bounds of their sums.
    Returns (group, taken) in order, or None after looking into the segments
    that kept a decision open.
    """
    low = high = np.zeros(histogram.size, np.int64)
    decided, wanted = [], []
    for group in order:
        fewest, most, settle = rule(group, low, high)
        least, upper, open_ = histogram.taken(group, fewest, most)
        wanted += [(group, s) for s in open_]
        decided.append((group, fewest))
        low, high = settle(low + least, high + upper)
    if not wanted:
        return decided
    depth = min(s.bits for _, s in wanted)
    histogram.look_into([(g, s) for g, s in wanted if s.bits == depth])
    return None


def ranked_in_prefixes(rows: DataFrame, histogram: Histogram, groups: Sequence[int]) -> DataFrame:
    """``rank`` of the rows of some groups by (key, id): the rows before their prefix, and their place in it.

    The table of prefixes has at most 4096 rows per group.
    """
    before = []
    for group in groups:
        total = 0
        for prefix, n in histogram.first_step.get(group, ()):
            before.append((group, prefix, total))
            total += n
    table = rows.sparkSession.createDataFrame(before, "group INT, prefix BIGINT, before BIGINT")
    place = Window.partitionBy("group", "prefix").orderBy("key", "id")
    numbered = rows.withColumn("prefix", F.shiftright("key", KEY_BITS - STEP_BITS)).withColumn("place", F.row_number().over(place))
    return numbered.join(table, ["group", "prefix"]).withColumn("rank", F.col("before") + F.col("place")).drop("prefix", "place", "before")
