"""Quality classifier: a byte-level convolutional network in numpy.

A document's bytes are cut into overlapping chunks of CHUNK bytes that cover
all of it. Filters over WIDTH embedded bytes, STEP apart, run along each chunk;
their largest responses in the chunk are its features. The mean of the chunks'
features gives one probability by a logistic unit. Embedding, filters and unit
are learned together, by gradient descent on a bounded sample of labelled
documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, STEP = 8, 4
#: A chunk is CELLS cells of CELL bytes; the next one starts CELLS - 1 cells later.
CELL, CELLS = 64, 4
CHUNK = CELL * CELLS
DIM, FILTERS = 6, 24
#: Bounds of the training sample: documents, and bytes taken of each in pieces spread over it.
SAMPLE_DOCUMENTS = 3000
SAMPLE_PIECES, PIECE = 6, 256
EPOCHS, BATCH, RATE = 8, 64, 0.01
ACCEPT = 0.7
SEED = 7


@dataclass
class Network:
    embedding: np.ndarray  # 256 x DIM; row 0 is padding and stays zero
    filters: np.ndarray  # WIDTH * DIM x FILTERS
    shift: np.ndarray  # FILTERS
    weight: np.ndarray  # FILTERS
    bias: np.ndarray  # 1

    @staticmethod
    def fresh() -> Network:
        rng = np.random.default_rng(SEED)
        embedding = rng.normal(0, 0.5, (256, DIM)).astype(np.float32)
        embedding[0] = 0
        filters = rng.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)).astype(np.float32)
        zeros = np.zeros(FILTERS, np.float32)
        return Network(embedding, filters, zeros, rng.normal(0, 0.1, FILTERS).astype(np.float32), np.zeros(1, np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.shift, self.weight, self.bias]


def _layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each padded with zeros to whole cells, and the number of cells of each."""
    cells = np.array([-(-len(t) // CELL) for t in texts], np.int64)
    symbols = np.zeros(int(cells.sum()) * CELL + WIDTH - STEP, np.uint8)
    at = 0
    for text, n in zip(texts, cells.tolist()):
        symbols[at : at + len(text)] = np.frombuffer(text, np.uint8)
        at += n * CELL
    return symbols, cells


def _chunk_starts(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First cell of every chunk, and the text it belongs to."""
    counts = np.where(cells > 0, np.maximum(1, -(-(cells - 1) // (CELLS - 1))), 0)
    owner = np.repeat(np.arange(len(cells)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = np.repeat(np.cumsum(cells) - cells, counts)
    return first + within * (CELLS - 1), owner


def _pairs(net: Network) -> np.ndarray:
    """Embeddings of two bytes at a time."""
    k = np.arange(1 << 16)
    return np.concatenate((net.embedding[k & 255], net.embedding[k >> 8]), axis=1)


def _features(net: Network, pairs: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Mean over a text's chunks of the largest rectified response of each filter; zeros for an empty text."""
    symbols, cells = _layout(texts)
    out = np.zeros((len(texts), FILTERS), np.float32)
    if not cells.sum():
        return out
    # A filter position is two steps wide, so each step is multiplied with both halves of the filters.
    first, second = np.split(net.filters, 2)
    steps = pairs.take(symbols.view("<u2"), axis=0).reshape(-1, STEP * DIM)
    response = (steps @ first)[:-1]
    response += (steps @ second)[1:]
    cell_max = response.reshape(-1, CELL // STEP, FILTERS).max(axis=1)
    starts, owner = _chunk_starts(cells)
    last = (np.cumsum(cells) - 1)[owner]
    chunk_max = cell_max[starts]
    for k in range(1, CELLS):
        np.maximum(chunk_max, cell_max[np.minimum(starts + k, last)], out=chunk_max)
    np.maximum(chunk_max + net.shift, 0, out=chunk_max)
    counts = np.bincount(owner, minlength=len(texts))
    some = np.flatnonzero(counts)
    sums = np.add.reduceat(chunk_max, (np.cumsum(counts) - counts)[some], axis=0)
    out[some] = sums / counts[some, None]
    return out


SCORE_BYTES = 1 << 19


def scores(net: Network, texts: list[str | None]) -> np.ndarray:
    """Probability of label 1 of each text, from all its bytes; a null text counts as empty.

    Texts are taken together up to SCORE_BYTES; a longer one is summed over
    stretches that share one cell with the next, so the memory is bounded.
    """
    features = np.zeros((len(texts), FILTERS), np.float32)
    pairs = _pairs(net)
    group: list[bytes] = []
    where: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal group, where, size
        if group:
            features[where] = _features(net, pairs, group)
        group, where, size = [], [], 0

    stride = SCORE_BYTES // ((CELLS - 1) * CELL) * (CELLS - 1) * CELL
    for k, text in enumerate(texts):
        data = (text or "").encode()
        if len(data) > SCORE_BYTES + CELL:
            parts = [data[b : b + stride + CELL] for b in range(0, len(data) - CELL, stride)]
            weights = [_chunk_starts(np.array([-(-len(p) // CELL)]))[0].size for p in parts]
            values = [_features(net, pairs, [p])[0] for p in parts]
            features[k] = np.average(values, axis=0, weights=weights)
            continue
        if size + len(data) > SCORE_BYTES:
            flush()
        group.append(data)
        where.append(k)
        size += len(data)
    flush()
    logit = features.astype(np.float64) @ net.weight.astype(np.float64) + float(net.bias[0])
    return 1 / (1 + np.exp(-logit))


def train(samples: list[list[str]], labels: list[int]) -> Network:
    """Fit a network to documents given as pieces of text, by Adam on the logistic loss."""
    net = Network.fresh()
    if not samples or len(set(labels)) < 2:
        share = (sum(labels) + 1) / (len(labels) + 2)
        net.weight[:] = 0
        net.bias[:] = np.log(share / (1 - share))
        return net
    pieces = [[p.encode()[:CHUNK] for p in own if p] or [b" "] for own in samples]
    y = np.array(labels, np.float32)
    prior = y.mean()
    net.bias[:] = np.log(prior / (1 - prior))
    rng = np.random.default_rng(SEED)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for begin in range(0, len(y), BATCH):
            rows = order[begin : begin + BATCH]
            step += 1
            for p, g, (m, v) in zip(net.parameters(), _gradients(net, [pieces[r] for r in rows], y[rows]), state):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            net.embedding[0] = 0
    return net


def _gradients(net: Network, batch: list[list[bytes]], y: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean logistic loss; every piece is one chunk."""
    owner = np.repeat(np.arange(len(batch)), [len(own) for own in batch])
    chunks = [p for own in batch for p in own]
    symbols = np.zeros((len(chunks), CHUNK + WIDTH), np.int64)
    for k, p in enumerate(chunks):
        symbols[k, : len(p)] = np.frombuffer(p, np.uint8)
    places = np.arange(0, CHUNK, STEP)[:, None] + np.arange(WIDTH)
    window = symbols[:, places]
    x = net.embedding[window].reshape(len(chunks), len(places), WIDTH * DIM)
    response = x @ net.filters
    best = response.argmax(axis=1)
    top = np.take_along_axis(response, best[:, None, :], axis=1)[:, 0, :] + net.shift
    active = np.maximum(top, 0)
    counts = np.bincount(owner).astype(np.float32)
    pooled = np.zeros((len(batch), FILTERS), np.float32)
    np.add.at(pooled, owner, active)
    pooled /= counts[:, None]
    p = 1 / (1 + np.exp(-(pooled @ net.weight + net.bias[0])))
    error = ((p - y) / len(y)).astype(np.float32)
    d_top = (error / counts)[owner][:, None] * net.weight * (top > 0)
    chosen = np.take_along_axis(x, best[:, :, None], axis=1)
    d_filters = np.einsum("cfi,cf->if", chosen, d_top)
    d_input = (d_top[:, :, None] * net.filters.T).reshape(-1, DIM)
    symbols_of = np.take_along_axis(window, best[:, :, None], axis=1).reshape(-1)
    d_embedding = np.zeros_like(net.embedding)
    np.add.at(d_embedding, symbols_of, d_input)
    decay = 1e-4
    return [
        d_embedding,
        d_filters + decay * net.filters,
        d_top.sum(axis=0),
        pooled.T @ error + decay * net.weight,
        np.array([error.sum()], np.float32),
    ]


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4; rows of fold 2 are never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Network:
    """Learn from labelled rows outside fold 2, at most SAMPLE_DOCUMENTS of them, chosen by a hash of doc_id.

    Of each, SAMPLE_PIECES pieces of PIECE characters reach the driver, spread
    evenly over the text. Without labels of both kinds the network returns a
    constant. Nulls in ids, labels or texts are left out.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold() != 2))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS)
    size = F.length("text")
    places = F.array(*[F.lit(k) for k in range(SAMPLE_PIECES)])
    spread = F.transform(places, lambda k: F.floor(k * F.greatest(size - PIECE, F.lit(0)) / (SAMPLE_PIECES - 1)).cast("int"))
    pieces = F.transform(F.array_distinct(spread), lambda s: F.col("text").substr(s + 1, F.lit(PIECE)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    rows = texts.join(chosen, "doc_id").select("doc_id", "y", pieces.alias("pieces")).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["pieces"]))
    return train([r["pieces"] for r in rows], [r["y"] for r in rows])


def score_table(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` (doc_id, text) to (doc_id, score, predicted), one row per row; a null or empty text has a score too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores(net, batch.column(1).to_pylist())
            predicted = pa.array((found >= ACCEPT).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), predicted], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, net: Network) -> DataFrame:
    """The rows of ``docs`` whose text the classifier accepts, with all their columns."""

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(scores(net, texts.tolist()))

    return docs.where(score("text") >= ACCEPT)
