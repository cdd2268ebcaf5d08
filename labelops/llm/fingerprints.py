"""Document fingerprints by one-permutation MinHash.

Every shingle is hashed once; the upper part of the hash picks one of BINS
bins and the smallest rest in a bin is kept. Empty bins copy a filled one found
by optimal densification: the bins h(bin, 1), h(bin, 2), ... are tried until one
is filled, the same sequence for all documents. Of each bin the lowest BITS bits
are kept and packed. The share of equal values, corrected for chance agreement
of BITS bits, estimates the Jaccard similarity of the shingle sets.

A text without words has the empty fingerprint. It is like another such text
(1.0) and unlike any other (0.0).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelops.llm.shingles import mix, shingle_lists

BINS = 512
BITS = 4

_BIN = np.uint64(64 - 9)
_BASE = np.arange(BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _tried(bins: np.ndarray, attempt: int) -> np.ndarray:
    return (mix(_BASE[bins] + np.uint64(attempt)) >> _BIN).astype(np.int64)


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """Low bits of each bin, one row of BINS values per text; -1 in all bins of a text without words."""
    out = np.full((len(texts), BINS), -1, np.int16)
    for k, shingles in enumerate(shingle_lists(texts)):
        if not len(shingles):
            continue
        hashed = mix(shingles ^ np.uint64(0x8EBC6AF09C88C6E3))
        bins = (hashed >> _BIN).astype(np.int64)
        order = np.lexsort((hashed, bins))
        first = order[np.concatenate(([True], np.diff(bins[order]) != 0))]
        row = out[k]
        row[bins[first]] = (hashed[first] & np.uint64((1 << BITS) - 1)).astype(np.int16)
        filled = row >= 0
        if len(first) == 1:
            row[:] = row[bins[first[0]]]
            continue
        missing = np.flatnonzero(~filled)
        attempt = 1
        while len(missing):
            at = _tried(missing, attempt)
            hit = filled[at]
            row[missing[hit]] = row[at[hit]]
            missing = missing[~hit]
            attempt += 1
    return out


def packed(row: np.ndarray) -> str:
    """A fingerprint as hexadecimal digits, one per bin; empty for a text without words."""
    if row[0] < 0:
        return ""
    return np.ascontiguousarray(row[0::2] << BITS | row[1::2]).astype(np.uint8).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of rows of fingerprints, corrected for chance agreement, from 0 to 1."""
    chance = 0.5**BITS
    corrected = np.maximum(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0)
    empty = (a[:, 0] < 0).astype(np.int8) + (b[:, 0] < 0)
    return np.where(empty == 2, 1.0, np.where(empty == 1, 0.0, corrected))


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) for every row of ``docs`` (doc_id, text); a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [packed(row) for row in fingerprints(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as much of the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


EDIT_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_ROWS = 256


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, doc_id, text, foreign) in order; each own row is compared with the row after it."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        texts = [r[2] for r in rows]
        changed = [edited(t, f) for t, f in zip(texts, texts[1:])]
        prints, others = fingerprints(texts), fingerprints(changed)
        own = [k for k, r in enumerate(rows[:-1]) if not r[3]]
        mine = prints[own]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[k][1] for k in own], pa.int64()),
                pa.array([len(texts[k]) for k in own], pa.int64()),
                pa.array([hashlib.sha256(changed[k].encode()).hexdigest() for k in own], pa.string()),
                pa.array([packed(prints[k]) for k in own], pa.string()),
                pa.array([packed(others[k]) for k in own], pa.string()),
                pa.array(likeness(mine, others[own])),
                pa.array(likeness(mine, prints[[k + 1 for k in own]])),
            ],
            names=[c.split()[0] for c in EDIT_SCHEMA.split(", ")],
        )

    rows: list[tuple] = []
    for batch in batches:
        columns = [batch.column(0), batch.column(1), batch.column(2), batch.column(3)]
        for start in range(0, batch.num_rows, _ROWS):
            part = [c.slice(start, _ROWS).to_pylist() for c in columns]
            rows += zip(part[0], part[1], [t or "" for t in part[2]], part[3])
            if len(rows) > 1:
                yield out(rows)
            rows = rows[-1:]


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts of ``docs`` (doc_id, text) and of their edited texts.

    The edited text takes its second half from the next document in descending
    order of doc_id (text breaks ties, nulls count as empty); after the last
    comes the first. One row per row of ``docs``; a single row follows itself.
    Rows of a null doc_id come last. Other columns are ignored.

    The documents are dealt once, into ranges of doc_id; each range also gets
    the first document of the range that follows it.
    """
    spark = docs.sparkSession
    own = F.col("doc_id").cast("long")
    docs = docs.select(
        own.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(own, F.lit(-(1 << 63))).alias("key")
    )
    # Three ranges per shuffle partition, so that dealing them by hash stays even.
    n = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit(k / n) for k in range(1, n)])
    cuts = sorted(set(docs.select(F.percentile_approx("key", shares, F.lit(10 * n))).first()[0] or []))
    # Ranges are numbered in descending order of doc_id.
    part = -F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("key"))) if cuts else F.lit(0)
    dealt = docs.select(part.alias("part"), "key", "doc_id", "text", F.lit(False).alias("foreign"))
    first = sorted(tuple(r) for r in dealt.groupBy("part").agg(F.max("key")).collect())
    if not first:
        return spark.createDataFrame([], EDIT_SCHEMA)
    follows = [(p, key) for (p, _), (_, key) in zip(first, first[1:] + first[:1])]
    heads = docs.where(F.col("key").isin([key for _, key in follows])).groupBy("key").agg(F.min("text").alias("text"))
    tails = spark.createDataFrame(follows, "part int, key long").join(heads, "key")
    tails = tails.select("part", "key", F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("foreign"))
    rows = dealt.union(tails).repartition("part").sortWithinPartitions("part", "foreign", F.desc("key"), "text")
    return rows.select("part", "doc_id", "text", "foreign").mapInArrow(_compare, EDIT_SCHEMA)
