"""Vector codes: each part of a vector is replaced by its nearest codebook entry.

Codebooks are learned by rounds of assignment and integer averaging over all
vectors. Most assignments do not change between rounds, which bounds tell
without distances: each part keeps an upper bound of the distance to its own
entry, lower bounds of those to its b next closest entries, and one outer bound
for all others. Bounds move with the entries; only where they no longer decide,
distances are computed, in integers, as deep into the list as needed. How deep
that was sets b of the part's position for the next round.

A round is one pass over the stored state that writes the next state and the
sums of its tasks; codebooks, sums and depths are all that reaches the driver,
and their sizes do not depend on the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelops.llm.scratch import discard
from labelops.session import scratch_path, stored

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Integer components must stay below this, so that sums of squares fit 64 bits.
LARGEST = 1 << 27

_STATE = "id bigint, label bigint, ints binary, own binary, upper binary, near binary, lower binary, outer binary, sums array<bigint>"
_CODES = "vec_id bigint, label bigint, code string, error bigint"


def _above(x: np.ndarray) -> np.ndarray:
    """A 32-bit number that is not below."""
    return np.nextafter((x * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))


def _below(x: np.ndarray) -> np.ndarray:
    """A 32-bit number that is not above."""
    return np.nextafter((x * (1 - 1e-12)).astype(np.float32), np.float32(-np.inf))


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Integer squared distances of rows (n, w) to entries (k, w) or to entries of each row (n, m, w)."""
    difference = x[:, None, :] - (entries[None] if entries.ndim == 2 else entries)
    return np.einsum("nkw,nkw->nk", difference, difference)


class PartState:
    """Assignments and bounds of one part position for a batch of vectors.

    ``near`` lists entries other than the own one, ``lower`` bounds their
    distances, ``outer`` bounds those of all entries that are not listed.
    """

    def __init__(self, own, upper, near, lower, outer):
        self.own, self.upper, self.near, self.lower, self.outer = own, upper, near, lower, outer

    @classmethod
    def unknown(cls, n: int, b: int) -> PartState:
        """A state that decides nothing."""
        return cls(
            np.zeros(n, np.uint8),
            np.full(n, np.inf, np.float32),
            np.zeros((n, b), np.uint8),
            np.full((n, b), np.inf, np.float32),
            np.full(n, -np.inf, np.float32),
        )

    def moved(self, moves: np.ndarray) -> None:
        """Entries moved by at most ``moves``."""
        self.upper = _above(self.upper + moves[self.own])
        self.lower = _below(self.lower - moves[self.near])
        self.outer = _below(self.outer - (moves.max() if len(moves) else 0.0))

    def resized(self, b: int) -> None:
        """Lists of b entries: longer ones lose their last to the outer bound, shorter ones get empty places."""
        n, had = self.near.shape
        if b < had:
            self.outer = np.minimum(self.outer, self.lower[:, b:].min(axis=1))
            self.near, self.lower = self.near[:, :b], self.lower[:, :b]
        elif b > had:
            self.near = np.concatenate([self.near, np.zeros((n, b - had), np.uint8)], axis=1)
            self.lower = np.concatenate([self.lower, np.full((n, b - had), np.inf, np.float32)], axis=1)

    def assign(self, x: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Make ``own`` the nearest entry, ties to the lower index.

        Returns how many vectors needed each depth: 0 for those that the bounds
        decided, i for those that needed i listed entries, b + 1 for those that
        needed all entries.
        """
        n, b = self.near.shape
        depths = np.zeros(b + 2, np.int64)
        # What bounds all entries from the i-th listed one on.
        bounds = np.minimum.accumulate(np.concatenate([self.lower, self.outer[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1]
        rows = np.flatnonzero(self.upper >= bounds[:, 0])
        if len(rows):
            finite = rows[np.isfinite(self.upper[rows])]
            own = _squares(x[finite], entries[self.own[finite]][:, None, :])[:, 0]
            self.upper[finite] = _above(np.sqrt(own))
            rows = rows[self.upper[rows] >= bounds[rows, 0]]
        decided = self.upper[rows][:, None] < bounds[rows]
        depth = np.where(decided.any(axis=1), decided.argmax(axis=1), b + 1)
        depths[0] = n - len(rows)
        np.add.at(depths, depth, 1)
        self._from_list(x, entries, rows[depth <= b], depth[depth <= b])
        self._from_all(x, entries, rows[depth > b])
        return depths

    def _from_list(self, x, entries, rows, depth) -> None:
        """The nearest of the own entry and the first ``depth`` listed ones."""
        if not len(rows):
            return
        b = self.near.shape[1]
        choice = np.concatenate([self.own[rows][:, None], self.near[rows]], axis=1)
        squares = _squares(x[rows], entries[choice])
        seen = np.arange(b + 1)[None] <= depth[:, None]
        # Empty places hold entry 0 with an infinite bound; they are not entries.
        seen[:, 1:] &= np.isfinite(self.lower[rows])
        rank = np.where(seen, squares, np.iinfo(np.int64).max)
        nearest = rank.min(axis=1)
        place = np.where(rank == nearest[:, None], choice.astype(np.int64), 256).argmin(axis=1)
        at = np.arange(len(rows))
        lower = np.concatenate([self.upper[rows][:, None], self.lower[rows]], axis=1)
        lower = np.where(seen, _below(np.sqrt(squares)), lower)
        own = choice[at, place].copy()
        choice[at, place], lower[at, place] = choice[:, 0], lower[:, 0]
        choice, lower = choice[:, 1:], lower[:, 1:]
        order = np.argsort(lower, axis=1, kind="stable")
        self.own[rows], self.upper[rows] = own, _above(np.sqrt(nearest))
        self.near[rows], self.lower[rows] = np.take_along_axis(choice, order, 1), np.take_along_axis(lower, order, 1)

    def _from_all(self, x, entries, rows) -> None:
        if not len(rows):
            return
        b = self.near.shape[1]
        squares = _squares(x[rows], entries)
        order = np.argsort(squares, axis=1, kind="stable")
        distance = np.sqrt(np.take_along_axis(squares, order, 1))
        listed = min(b, len(entries) - 1)
        self.own[rows], self.upper[rows] = order[:, 0], _above(distance[:, 0])
        self.near[rows, :listed], self.lower[rows, :listed] = order[:, 1 : listed + 1], _below(distance[:, 1 : listed + 1])
        self.near[rows, listed:], self.lower[rows, listed:] = 0, np.inf
        self.outer[rows] = _below(distance[:, listed + 1]) if len(entries) > listed + 1 else np.inf


def next_width(depths: np.ndarray, entries: int) -> int:
    """b of the next round: the greatest depth that a listed entry decided, twice as many if over
    an eighth of the vectors needed all entries; at least one and an eighth of the entries."""
    b = len(depths) - 2
    used = np.flatnonzero(depths[: b + 1])
    wanted = int(used[-1]) if len(used) else 1
    if depths[b + 1] * 8 > depths.sum():
        wanted = 2 * b
    return max(1, entries // 8, min(wanted, entries - 1))


def _matrix(column: pa.Array, dtype, n: int) -> np.ndarray:
    """A binary column of equally long values as a matrix."""
    flat = np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)
    return flat.reshape(n, -1).copy()


def _binary(matrix: np.ndarray) -> pa.Array:
    n = len(matrix)
    data = np.ascontiguousarray(matrix)
    width = data.nbytes // n if n else 0
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _integers(vectors: list[list[float]], size: int) -> np.ndarray:
    for vector in vectors:
        if len(vector) != size:
            raise ValueError(f"vectors of {size} and of {len(vector)} components")
    ints = np.floor(SCALE * np.array(vectors, dtype=np.float64).reshape(len(vectors), size))
    if len(ints) and np.abs(ints).max() >= LARGEST:
        raise ValueError(f"components of {LARGEST // SCALE} and more are not supported")
    return ints.astype(np.int64)


class _Pass:
    """One assignment pass over batches of vectors or of stored state."""

    def __init__(self, codebooks: np.ndarray, moves: np.ndarray | None, had: list[int], widths: list[int]):
        self.codebooks, self.moves, self.had, self.widths = codebooks, moves, had, widths

    @property
    def first(self) -> bool:
        return self.moves is None

    def assigned(self, batch: pa.RecordBatch) -> tuple[np.ndarray, list[PartState], list[np.ndarray]]:
        parts, _, w = self.codebooks.shape
        n = batch.num_rows
        if self.first:
            ints = _integers(batch.column(2).to_pylist(), parts * w)
            states = [PartState.unknown(n, b) for b in self.widths]
        else:
            ints = _matrix(batch.column(2), np.int32, n).astype(np.int64)
            own, upper, near, lower, outer = (
                _matrix(batch.column(3 + i), t, n) for i, t in enumerate((np.uint8, np.float32, np.uint8, np.float32, np.float32))
            )
            states, at = [], 0
            for p, b in enumerate(self.had):
                state = PartState(own[:, p].copy(), upper[:, p].copy(), near[:, at : at + b], lower[:, at : at + b], outer[:, p].copy())
                state.moved(self.moves[p])
                state.resized(self.widths[p])
                states.append(state)
                at += b
        depths = [s.assign(ints[:, p * w : (p + 1) * w], self.codebooks[p]) for p, s in enumerate(states)]
        return ints, states, depths

    def states(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The next state of every vector, and one row of the task's sums."""
        parts, k, w = self.codebooks.shape
        totals = np.zeros((parts, k, w + 1), np.int64)
        reached = [np.zeros(b + 2, np.int64) for b in self.widths]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ints, states, depths = self.assigned(batch)
            for p, state in enumerate(states):
                reached[p] += depths[p]
                np.add.at(totals[p], state.own, np.concatenate([ints[:, p * w : (p + 1) * w], np.ones((n, 1), np.int64)], axis=1))
            stacked = [np.stack([s.own for s in states], 1), np.stack([s.upper for s in states], 1)]
            stacked += [np.concatenate([s.near for s in states], 1), np.concatenate([s.lower for s in states], 1)]
            stacked += [np.stack([s.outer for s in states], 1)]
            columns = [batch.column(0), batch.column(1), _binary(ints.astype(np.int32)), *map(_binary, stacked)]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.list_(pa.int64()))], names=_names(_STATE))
        numbers = np.concatenate([totals.ravel(), *reached]).tolist()
        empty = [pa.nulls(1, pa.int64())] * 2 + [pa.nulls(1, pa.binary())] * 6
        yield pa.RecordBatch.from_arrays([*empty, pa.array([numbers], pa.list_(pa.int64()))], names=_names(_STATE))

    def codes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Codes and errors by the last codebooks."""
        w = self.codebooks.shape[2]
        for batch in batches:
            if not batch.num_rows:
                continue
            ints, states, _ = self.assigned(batch)
            error = np.zeros(batch.num_rows, np.int64)
            for p, state in enumerate(states):
                error += _squares(ints[:, p * w : (p + 1) * w], self.codebooks[p][state.own][:, None, :])[:, 0]
            own = np.stack([s.own for s in states], 1)
            code = pa.array([row.tobytes().hex() for row in own], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code, pa.array(error)], names=_names(_CODES))


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows whose vector is whole and finite."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    return rows.where(F.col("embedding").isNotNull() & ~odd)


def first_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray | None:
    """Entries (parts, k, width): the parts of the smallest ids, k of them; None without vectors.

    Of rows that share an id the least vector counts; null ids come last and count as one id.
    """
    order = F.asc_nulls_last("vec_id")
    ids = [r["vec_id"] for r in kept.select("vec_id").distinct().orderBy(order).limit(entries).collect()]
    # Only these few rows are shuffled whole.
    first = kept.where(F.col("vec_id").isin([i for i in ids if i is not None]) | (F.col("vec_id").isNull() & F.lit(None in ids)))
    rows = first.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy(order).collect()
    if not rows:
        return None
    size = len(rows[0]["embedding"])
    if size % parts or not size:
        raise ValueError(f"vectors of {size} components cannot be cut into {parts} equal parts")
    ints = _integers([r["embedding"] for r in rows], size)
    return ints.reshape(len(rows), parts, size // parts).transpose(1, 0, 2).copy()


def averaged(codebooks: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Entries replaced by the mean of their parts, rounded down; entries without parts stay."""
    sums, counts = totals[..., :-1], totals[..., -1:]
    return np.where(counts > 0, sums // np.maximum(counts, 1), codebooks)


def learn_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, code, error) of every kept row, and the codebooks (parts, k, width).

    ``vectors`` has vec_id, embedding and label; other columns are not read.
    Rows whose vector is null or holds null or non-finite components are left
    out; null ids and labels and repeated rows are kept. With fewer ids than
    ``entries`` the codebooks have that many entries. Without vectors the
    result is empty and there are no codebooks. Vectors of unequal sizes, sizes
    that ``parts`` does not divide and components beyond ``LARGEST`` raise.
    """
    if entries > 256:
        raise ValueError("entries are numbered by one byte")
    kept = kept_vectors(vectors)
    codebooks = first_codebooks(kept, parts, entries)
    if codebooks is None:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), None
    spark = vectors.sparkSession
    k = codebooks.shape[1]
    widths = [max(1, k // 4)] * parts
    state, path, step = kept, None, _Pass(codebooks, None, [], widths)
    for _ in range(rounds):
        target = scratch_path(spark, "vector-state")
        state.mapInArrow(step.states, _STATE).write.parquet(target)
        if path is not None:
            discard(spark, path)
        path, written = target, spark.read.schema(_STATE).parquet(target)
        sums = written.where("sums is not null").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
        numbers = np.zeros(codebooks.shape[0] * k * (codebooks.shape[2] + 1) + sum(b + 2 for b in widths), np.int64)
        for row in sums.collect():
            numbers[row["at"]] = row["x"]
        size = codebooks.shape[0] * k * (codebooks.shape[2] + 1)
        was, codebooks = codebooks, averaged(codebooks, numbers[:size].reshape(codebooks.shape[0], k, -1))
        moves = np.sqrt(((codebooks - was) ** 2).sum(axis=2)) * (1 + 1e-12)
        at, had, widths = size, widths, []
        for b in had:
            widths.append(next_width(numbers[at : at + b + 2], k))
            at += b + 2
        state, step = written.where("sums is null"), _Pass(codebooks, moves, had, widths)
    return state.mapInArrow(step.codes, _CODES), codebooks


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept row; nulls and odd input as in ``learn_codes``."""
    codes, codebooks = learn_codes(vectors, parts, entries, rounds)
    if codebooks is None:
        none = F.lit(None).cast("string")
        return codes.select("vec_id", "code", "error", F.col("error").alias("label_error"), none.alias("codebooks_sha256"))
    codes = stored(codes, "codes")
    by_label = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    joined = codes.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
