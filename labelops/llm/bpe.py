"""Byte-level BPE over a pair occurrence index.

Texts are split into pieces and words as the vocabulary's pattern asks. The
words of a batch that are not known yet are laid out as one array of symbols.
An index maps each mergeable pair, named by its rank, to all positions where it
occurs; the active ranks are taken in ascending order, all positions of a rank
are merged at once, and the pairs that arise next to them enter the lists of
their ranks. A pair that holds a new symbol ranks after it, so this order gives
the same merges as taking each word by itself.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import itertools
import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the published pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_ENTRIES = 350_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves, the rest for the
    characters from code point 256 on.
    """
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = itertools.count(256)
    return [chr(b if b in own else next(spare)) for b in range(256)]


def pieces(text: str) -> list[str]:
    """Cut a text before every single space between other characters.

    No word of the pattern spans such a place, nor does its one look-ahead, so
    pieces can be encoded by themselves.
    """
    parts = text.split(" ")
    out = [parts[0]]
    for part in parts[1:]:
        if part and not part[0].isspace() and out[-1] and not out[-1][-1].isspace():
            out.append(" " + part)
        else:
            out[-1] += " " + part
    return out


_MARKS = ".,;:!?"


def atoms(piece: str) -> list[str]:
    """Cut a piece further, around single line feeds and before marks that follow letters.

    The pattern always ends a word at these places, so many pieces share their parts.
    """
    out: list[str] = []
    lines = piece.split("\n") if "\n" in piece else [piece]
    if len(lines) > 1 and any(not line or line[0] in " \t\r" and k or line[-1].isspace() or len(line.split()) > 1 for k, line in enumerate(lines)):
        return [piece]
    for k, line in enumerate(lines):
        if k:
            out.append("\n")
        word = line.rstrip(_MARKS)
        if word is not line and len(word) < len(line) and (word[1:] if word[:1] == " " else word).isalpha():
            out += [word, line[len(word) :]]
        else:
            out.append(line)
    return out


class Bpe:
    """Encoder and decoder of one byte-level vocabulary file in the tokenizers format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        symbols = byte_symbols()
        to_byte = {s: b for b, s in enumerate(symbols)}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.token_bytes = [b""] * size
        for token, k in vocab.items():
            self.token_bytes[k] = bytes(to_byte[c] for c in token)
        for token, k in self.specials.items():
            self.token_bytes[k] = token.encode()
        self.byte_ids = np.array([vocab[s] for s in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = self.left << 32 | self.right
        self.by_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.by_key]
        self.split = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.pattern = regex.compile(PATTERN)
        #: Ids of pieces; ids of a space and what follows it, None where it can't be cut there.
        self.known: dict[str, bytes] = {}
        self.spaced: dict[str, bytes | None] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 where it cannot be merged."""
        if not len(self.keys):
            return np.full(len(left), -1, np.int64)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by_key[at], -1)

    def merge_words(self, words: list[str]) -> list[bytes]:
        """Token ids of words, as 32-bit integers, merged together over one pair occurrence index."""
        data = [w.encode() for w in words]
        ends = np.cumsum([len(d) for d in data])
        if not len(ends) or not ends[-1]:
            return [b""] * len(words)
        symbol = self.byte_ids[np.frombuffer(b"".join(data), np.uint8)]
        n = len(symbol)
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        ends_at = ends[ends > 0]
        after[ends_at - 1] = -1
        before[ends_at[ends_at < n]] = -1

        lists: dict[int, list] = defaultdict(list)
        active: list[int] = []

        def note(positions: np.ndarray) -> None:
            """Enter the pairs that start at these positions."""
            rank = self.ranks(symbol[positions], symbol[after[positions]])
            positions, rank = positions[rank >= 0], rank[rank >= 0]
            if len(rank) > 1:
                order = np.argsort(rank, kind="stable")
                positions, rank = positions[order], rank[order]
            begin = np.flatnonzero(np.diff(rank, prepend=-1)).tolist()
            for r, b, e in zip(rank[begin].tolist(), begin, begin[1:] + [len(rank)]):
                if r not in lists:
                    heapq.heappush(active, r)
                lists[r].append(positions[b:e])

        note(np.flatnonzero(after >= 0))
        while active:
            r = heapq.heappop(active)
            found = lists.pop(r)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            a, b = self.left[r], self.right[r]
            at = at[(symbol[at] == a) & (after[at] >= 0)]
            at = at[symbol[after[at]] == b]
            if a == b and len(at) > 1:
                at = self._disjoint(np.sort(at), after)
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            symbol[at] = self.merged[r]
            symbol[gone] = -1
            after[at] = beyond
            right = beyond >= 0
            before[beyond[right]] = at[right]
            prior = before[at]
            note(np.concatenate((prior[prior >= 0], at[right])))
        alive = symbol >= 0
        counts = (4 * np.concatenate(([0], np.cumsum(alive)))[np.concatenate(([0], ends))]).tolist()
        ids = symbol[alive].astype("<u4").tobytes()
        return [ids[b:e] for b, e in zip(counts, counts[1:])]

    @staticmethod
    def _disjoint(at: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Of pairs of one symbol with itself, the leftmost ones that do not overlap."""
        kept, taken = [], -1
        for p in at.tolist():
            if p != taken:
                kept.append(p)
                taken = int(after[p])
        return np.array(kept, np.int64)

    def _learn(self, new: list[str]) -> list[bytes]:
        """Ids of pieces."""
        words = [self.pattern.findall(p) for p in new]
        distinct = list({w for own in words for w in own})
        ids = dict(zip(distinct, self.merge_words(distinct)))
        return [ids[own[0]] if len(own) == 1 else b"".join([ids[w] for w in own]) for own in words]

    def _segments(self, segments: set[str]) -> dict[str, bytes]:
        """Ids of texts without special tokens."""
        first, rest = set(), set()
        for segment in segments:
            parts = segment.split(" ")
            first.add(parts[0])
            rest.update(parts[1:])
        rest -= self.spaced.keys()
        plain = {p: atoms(" " + p) for p in rest if p and not p[0].isspace() and not p[-1].isspace()}
        self._know({a for own in plain.values() for a in own} | first)
        known = self.known
        self.spaced.update(dict.fromkeys(rest))
        for part, own in plain.items():
            self.spaced[part] = known[own[0]] if len(own) == 1 else b"".join([known[a] for a in own])
        out, uncut = {}, {}
        for segment in segments:
            head, *parts = segment.split(" ")
            ids = [self.spaced[p] for p in parts]
            if ids and (None in ids or not head or head[-1].isspace()):
                uncut[segment] = pieces(segment)
            else:
                out[segment] = self.known[head] + b"".join(ids)
        self._know({p for own in uncut.values() for p in own})
        for segment, own in uncut.items():
            out[segment] = b"".join([self.known[p] for p in own])
        return out

    def _know(self, new: set[str]) -> None:
        unknown = list(new - self.known.keys())
        self.known.update(zip(unknown, self._learn(unknown)))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of each text; null counts as empty. Strings of special tokens become their ids."""
        for cache in (self.known, self.spaced):
            if len(cache) > CACHE_ENTRIES:
                cache.clear()
        cut = {}
        for text in set(texts):
            segments, marks = [text or ""], []
            if self.split is not None and self.split.search(segments[0]):
                marks = self.split.findall(text)
                segments = self.split.split(text)
            cut[text] = (segments, marks)
        collecting = gc.isenabled()
        gc.disable()
        try:
            encoded = self._segments({s for segments, _ in cut.values() for s in segments})
        finally:
            if collecting:
                gc.enable()
        ids = {}
        for text, (segments, marks) in cut.items():
            parts = [encoded[s] for s in segments]
            for k, mark in reversed(list(enumerate(marks, 1))):
                parts.insert(k, np.array(self.specials[mark], "<u4").tobytes())
            ids[text] = np.frombuffer(b"".join(parts), "<u4")
        return [ids[text] for text in texts]

    def decode(self, ids: np.ndarray) -> str:
        """The text of token ids, special ones included; invalid UTF-8 becomes U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One vocabulary per worker process and path."""
    return Bpe(path)


_ROWS = 2048


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            yield batch.slice(start, _ROWS)


def _lists(encoded: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(ids) for ids in encoded])))
    flat = np.concatenate([np.empty(0, "<u4"), *encoded]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def encode_table(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) for every row of ``docs`` (doc_id, text); a null or empty text has no ids.

    Rows stay as they are, repeated ones too; other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in _slices(batches):
            ids = _lists(bpe.encode(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_table(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) for rows of (doc_id, ids); null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in _slices(batches):
            texts = [bpe.decode(np.array(ids or [], np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_and_decode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Both directions in one pass: (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]).

    ids_sha256 is that of the decimal ids joined by commas, decoded_sha256 that
    of the decoded text in UTF-8, both in lower-case hexadecimal.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        decimal = [str(k) for k in range(len(bpe.token_bytes))]
        for batch in _slices(batches):
            encoded = bpe.encode(batch.column(1).to_pylist())
            columns = [
                batch.column(0),
                pa.array([len(ids) for ids in encoded], pa.int64()),
                pa.array([hashlib.sha256(",".join(map(decimal.__getitem__, ids.tolist())).encode()).hexdigest() for ids in encoded], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(ids).encode()).hexdigest() for ids in encoded], pa.string()),
            ]
            if with_ids:
                columns.append(_lists(encoded))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
