"""Scoring in batches that are padded to a token budget.

A model that scores token matrices pads every text of a batch to the longest.
Rows of an Arrow batch are sorted by length first and cut so that rows x width
stays within the budget; the scores go back to the rows' own order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelops.operators.training import JointClassifier, _sigmoid, hashed_words

#: Number that stands for no token.
PAD = -1


def token_batches(lengths: np.ndarray, budget: int, by_length: bool = True) -> Iterator[np.ndarray]:
    """Row numbers of batches of at most ``budget`` padded tokens; a longer text is a batch of its own."""
    order = np.argsort(lengths, kind="stable") if by_length else np.arange(len(lengths))
    first, width = 0, 0
    for at, row in enumerate(order):
        wider = max(width, int(lengths[row]))
        if at > first and wider * (at + 1 - first) > budget:
            yield order[first:at]
            first, wider = at, int(lengths[row])
        width = wider
    if first < len(order):
        yield order[first:]


def padded(offsets: np.ndarray, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The tokens of some rows as a matrix, filled up with PAD."""
    lengths = offsets[rows + 1] - offsets[rows]
    matrix = np.full((len(rows), max(1, int(lengths.max(initial=0)))), PAD, dtype=np.int64)
    for i, row in enumerate(rows):
        matrix[i, : lengths[i]] = values[offsets[row] : offsets[row + 1]]
    return matrix


def score_matrix(model: JointClassifier, tokens: np.ndarray) -> np.ndarray:
    """Probabilities of every label for a padded token matrix."""
    weights = np.vstack([model.weights[:-1] * model.scale[:, None], np.zeros((1, model.weights.shape[1]))])
    return _sigmoid(weights[tokens].sum(axis=1) + model.weights[-1])


def padded_scores(df: DataFrame, model: JointClassifier, budget: int, text: str = "text", by_length: bool = True) -> DataFrame:
    """Add ``scores``, ``n_tokens`` and ``width``, the length its batch was padded to. A null text has no tokens."""

    @F.arrow_udf("scores array<double>, n_tokens bigint, width bigint")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for words in batches:
            offsets, values = words.offsets.to_numpy(), words.values.to_numpy(zero_copy_only=False)
            lengths = np.diff(offsets)
            scores, widths = np.zeros((len(words), model.weights.shape[1])), np.zeros(len(words), np.int64)
            for rows in token_batches(lengths, budget, by_length):
                matrix = padded(offsets, values, rows)
                scores[rows], widths[rows] = score_matrix(model, matrix), matrix.shape[1]
            starts = np.arange(len(words) + 1, dtype=np.int32) * scores.shape[1]
            columns = [pa.ListArray.from_arrays(pa.array(starts), pa.array(scores.ravel())), pa.array(lengths.astype(np.int64)), pa.array(widths)]
            yield pa.StructArray.from_arrays(columns, names=["scores", "n_tokens", "width"])

    words = F.coalesce(hashed_words(text, model.n_features), F.array().cast("array<int>"))
    return df.withColumn("__scored", run(words)).select(*df.columns, "__scored.*")


def padding_share(scored: DataFrame) -> float:
    """Share of the padded matrices that holds no token; one number reaches the driver."""
    return scored.agg(1 - F.try_divide(F.sum("n_tokens"), F.sum("width"))).first()[0] or 0.0
