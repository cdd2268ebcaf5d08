"""Joint training of a linear classifier for all labels, epoch by epoch.

All labels share one weight matrix. An epoch is one job: every task adds up the
losses and the gradient matrix of its rows, blocks of the matrix are summed in
a second stage, and only the sum reaches the driver, whose size is features x
labels whatever the number of rows. The driver takes a quasi-Newton step for
each label on its own; a label whose loss did not fall tries a shorter step in
the next epoch, so no epoch is spent on one label alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from labelops.functions.text import tokens
from labelops.operators.curves import weighted_curve_metrics
from labelops.session import stored
from labelops.vocab import LABELS

N_FEATURES = 1 << 14
#: Rows whose words are held as one sparse matrix.
SLICE = 512
#: Words of such a matrix, but for a single longer row.
SLICE_WORDS = 1 << 18
#: Values of one block of a matrix that tasks add up.
BLOCK = 1 << 14
#: Steps the quasi-Newton direction is built from.
MEMORY = 5


def hashed_words(text: Column | str, n_features: int = N_FEATURES) -> Column:
    """Feature numbers of the words of a text, repeats included."""
    return F.transform(tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(n_features)).cast("int"))


def _words(text: Column | str, n_features: int) -> Column:
    """Feature numbers of the words of a text; a null text has none."""
    return F.coalesce(hashed_words(text, n_features), F.array().cast("array<int>"))


def _counts(words: pa.Array, n_features: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Sparse word counts of slices of rows: (first row, rows, row, feature, count)."""
    offsets = words.offsets.to_numpy()
    flat = words.values.to_numpy(zero_copy_only=False)
    first = 0
    while first < len(words):
        # Rows of long texts make shorter slices, so that a slice is bounded by its words too.
        last = int(np.searchsorted(offsets[: first + SLICE + 1], offsets[first] + SLICE_WORDS, side="right")) - 1
        last = min(max(last, first + 1), len(words))
        lengths = np.diff(offsets[first : last + 1])
        row = np.repeat(np.arange(last - first), lengths)
        cells, count = np.unique(row * n_features + flat[offsets[first] : offsets[last]].astype(np.int64), return_counts=True)
        yield first, last - first, cells // n_features, cells % n_features, count.astype(np.float64)
        first = last


def _blocks(values: np.ndarray) -> pa.RecordBatch:
    flat = values.ravel()
    parts = [flat[i : i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["block", "data"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(data)
            sums[block] = sums[block] + part if block in sums else part
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["block", "data"]
        )


def _total(rows: DataFrame, per_task: Callable[[Iterator[pa.RecordBatch]], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Sum over all tasks of an array of the given shape, as one job of two stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _blocks(per_task(batches))

    schema = "block int, data binary"
    size = int(np.prod(shape))
    parts = rows.mapInArrow(run, schema).repartition(-(-size // BLOCK), "block").mapInArrow(_summed, schema).collect()
    total = np.zeros(size)
    for part in parts:
        at = part["block"] * BLOCK
        values = np.frombuffer(part["data"])
        total[at : at + len(values)] = values
    return total.reshape(shape)


@dataclass
class JointClassifier:
    """Weights (features + 1, labels), the last row being the intercepts, and the scale of each feature."""

    weights: np.ndarray
    scale: np.ndarray

    @property
    def n_features(self) -> int:
        return len(self.scale)

    def margins(self, n_rows: int, row: np.ndarray, feature: np.ndarray, count: np.ndarray) -> np.ndarray:
        parts = self.weights[feature] * (count * self.scale[feature])[:, None]
        out = np.repeat(self.weights[-1:], n_rows, axis=0)
        if len(row):
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            out[row[starts]] += np.add.reduceat(parts, starts, axis=0)
        return out

    def scores(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Add ``scores``, one probability per label; only the feature numbers go to Python."""
        return df.withColumn("scores", self.scores_of(_words(text, self.n_features)))

    def scores_of(self, words: Column | str) -> Column:
        """One probability per label for a column of feature numbers."""
        model = self

        @F.arrow_udf(ArrayType(DoubleType()))
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for words in batches:
                found = [_sigmoid(model.margins(n, *cells)) for _, n, *cells in _counts(words, model.n_features)]
                scores = np.concatenate(found) if found else np.zeros((0, model.weights.shape[1]))
                starts = np.arange(len(scores) + 1, dtype=np.int32) * scores.shape[1]
                yield pa.ListArray.from_arrays(pa.array(starts), pa.array(scores.ravel()))

        return run(words)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _losses(margins: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (np.logaddexp(0, margins) - y * margins).sum(axis=0)


def _feature_scale(rows: DataFrame, n_features: int) -> tuple[np.ndarray, int]:
    """One over the standard deviation of each feature's count (0 where it never varies), and the number of rows."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        sums = np.zeros((2, n_features + 1))
        for batch in batches:
            sums[:, -1] += batch.num_rows
            for _, _, _, feature, count in _counts(batch.column(0), n_features):
                sums[0, :-1] += np.bincount(feature, count, n_features)
                sums[1, :-1] += np.bincount(feature, count**2, n_features)
        return sums

    sums = _total(rows.select("words"), per_task, (2, n_features + 1))
    n = int(round(sums[0, -1]))
    if n < 2:
        return np.zeros(n_features), n
    variance = (sums[1, :-1] - sums[0, :-1] ** 2 / n) / (n - 1)
    return np.where(variance > 1e-12, 1 / np.sqrt(np.maximum(variance, 1e-12)), 0.0), n


def _evaluate(rows: DataFrame, model: JointClassifier, n: int, reg: float) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each label and the gradient matrix, in one job."""
    features, labels = model.n_features, model.weights.shape[1]

    def per_task(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        sums = np.zeros((features + 2, labels))
        for batch in batches:
            y = np.array(batch.column(1).to_pylist(), dtype=np.float64).reshape(batch.num_rows, labels)
            for first, n_rows, row, feature, count in _counts(batch.column(0), features):
                own = y[first : first + n_rows]
                margins = model.margins(n_rows, row, feature, count)
                rest = _sigmoid(margins) - own
                values = count * model.scale[feature]
                for label in range(labels):
                    sums[:features, label] += np.bincount(feature, values * rest[row, label], features)
                sums[features] += rest.sum(axis=0)
                sums[features + 1] += _losses(margins, own)
        return sums

    sums = _total(rows, per_task, (features + 2, labels)) / max(n, 1)
    gradient = sums[:-1]
    gradient[:-1] += reg * model.weights[:-1]
    return sums[-1] + reg / 2 * (model.weights[:-1] ** 2).sum(axis=0), gradient


@dataclass
class _Steps:
    """Limited-memory quasi-Newton state of every label."""

    weights: np.ndarray
    loss: np.ndarray
    gradient: np.ndarray
    moves: list[np.ndarray] = field(default_factory=list)
    turns: list[np.ndarray] = field(default_factory=list)
    direction: np.ndarray | None = None
    length: np.ndarray | None = None

    def aim(self, renew: np.ndarray) -> None:
        """A new direction for the labels of the mask."""
        q, used = self.gradient.copy(), []
        for move, turn in zip(reversed(self.moves), reversed(self.turns)):
            curve = (move * turn).sum(axis=0)
            good = curve > 1e-12
            inverse = np.where(good, 1 / np.where(good, curve, 1), 0)
            alpha = inverse * (move * q).sum(axis=0)
            q -= alpha * turn
            used.append((move, turn, inverse, alpha, good, curve))
        if used:
            _, turn, _, _, good, curve = used[0]
            square = (turn**2).sum(axis=0)
            q *= np.where(good, curve / np.where(square > 0, square, 1), 1)
        for move, turn, inverse, alpha, _, _ in reversed(used):
            q += (alpha - inverse * (turn * q).sum(axis=0)) * move
        uphill = (q * self.gradient).sum(axis=0) <= 0
        q[:, uphill] = self.gradient[:, uphill]
        norm = np.sqrt((self.gradient**2).sum(axis=0))
        first = np.minimum(1, 1 / np.where(norm > 0, norm, 1)) if not used else np.ones(len(norm))
        if self.direction is None:
            self.direction, self.length = -q, first
        else:
            self.direction[:, renew], self.length[renew] = -q[:, renew], first[renew]

    def trial(self) -> np.ndarray:
        return self.weights + self.length * self.direction

    def take(self, trial: np.ndarray, loss: np.ndarray, gradient: np.ndarray) -> None:
        """Keep the trial for the labels whose loss fell enough; the others halve their step."""
        slope = (self.gradient * self.direction).sum(axis=0)
        fell = loss <= self.loss + 1e-4 * self.length * np.minimum(slope, 0)
        # A label that stays has no move, which the direction leaves out.
        self.moves.append(np.where(fell, trial - self.weights, 0.0))
        self.turns.append(np.where(fell, gradient - self.gradient, 0.0))
        self.moves, self.turns = self.moves[-MEMORY:], self.turns[-MEMORY:]
        self.weights = np.where(fell, trial, self.weights)
        self.gradient = np.where(fell, gradient, self.gradient)
        self.loss = np.where(fell, loss, self.loss)
        self.length = np.where(fell, self.length, self.length / 2)
        self.aim(fell)


@dataclass
class Training:
    """The best classifier of a run, and what each epoch reached.

    ``history`` holds (epoch, mean loss of the labels, validation AP or None);
    ``best_epoch`` is the first with the highest AP, the last one without
    validation rows.
    """

    classifier: JointClassifier
    history: list[tuple[int, float, float | None]]
    best_epoch: int

    def table(self, df: DataFrame) -> DataFrame:
        """The history as a table, the best epoch marked."""
        rows = [(e, loss, ap, e == self.best_epoch) for e, loss, ap in self.history]
        return df.sparkSession.createDataFrame(rows, "epoch INT, loss DOUBLE, ap DOUBLE, best BOOLEAN")


def train_jointly(
    train: DataFrame,
    n_labels: int = len(LABELS),
    max_epochs: int = 10,
    reg: float = 0.01,
    n_features: int = N_FEATURES,
    validation: DataFrame | None = None,
    patience: int = 3,
    start: JointClassifier | None = None,
    text: str = "text",
) -> Training:
    """Train on (text, y) by one job per epoch; epoch 0 is the start.

    With validation rows every epoch is scored on them, whose words are found
    once like those of the training rows; training ends after
    ``patience`` epochs without a higher AP, and the weights of the best epoch
    are the result. ``start`` continues from the weights of an earlier training,
    with its feature scales. A null text has no words. Without training rows
    the start is returned as it is.
    """
    words = _words(text, n_features).alias("words")
    rows = stored(train.select(words, "y"), "training-rows")
    scale, n = _feature_scale(rows, n_features)
    if start is not None:
        if start.weights.shape != (n_features + 1, n_labels):
            raise ValueError(f"the start has weights {start.weights.shape}, not {(n_features + 1, n_labels)}")
        scale = start.scale
    model = JointClassifier(np.zeros((n_features + 1, n_labels)) if start is None else start.weights, scale)

    held_out = None if validation is None else stored(validation.select(words, "y"), "validation-rows")

    def measured(classifier: JointClassifier) -> float | None:
        if held_out is None:
            return None
        return weighted_curve_metrics(held_out.select("y", classifier.scores_of("words").alias("scores")), []).first()["ap"]

    loss, gradient = _evaluate(rows, model, n, reg)
    steps = _Steps(model.weights, loss, gradient)
    steps.aim(np.ones(n_labels, bool))
    best, best_epoch, best_ap = model, 0, measured(model)
    history = [(0, float(loss.mean()), best_ap)]
    for epoch in range(1, max_epochs + 1 if n else 1):
        trial = steps.trial()
        steps.take(trial, *_evaluate(rows, replace(model, weights=trial), n, reg))
        model = replace(model, weights=steps.weights)
        ap = measured(model)
        history.append((epoch, float(steps.loss.mean()), ap))
        if validation is None or best_ap is None or (ap is not None and ap > best_ap):
            best, best_epoch, best_ap = model, epoch, ap
        elif epoch - best_epoch >= patience:
            break
    return Training(best, history, best_epoch)

