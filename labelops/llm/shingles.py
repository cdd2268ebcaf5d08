"""Word shingles of many texts at once, in numpy.

Words are the runs of bytes other than ASCII white space, A-Z lower-cased. A
text's shingles are its sequences of five words; a text with one to four words
has its whole sequence as its only shingle; without words it has none. Words
and shingles are stood for by 64-bit hashes.

A word's hash is a difference of running sums of weighted bytes, so the work
is a few array operations per byte, whatever the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS_PER_SHINGLE = 5
CHUNK_BYTES = 1 << 20

_STEP = 0x9E3779B97F4A7C15 | 1
_STEP_INVERSE = pow(_STEP, -1, 1 << 64)
_FACTORS = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(64)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    values[65:91] = values[97:123]
    return values


_VALUES = _byte_values()
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of the step and of its inverse, extended when a longer text comes."""

    def __init__(self):
        self.up = self.down = np.empty(0, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * CHUNK_BYTES)
            self.up, self.down = _powers(_STEP, size), _powers(_STEP_INVERSE, size)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start offsets, end offsets and hashes of the words of a byte string."""
    raw = np.frombuffer(data, dtype=np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.empty(0, dtype=np.uint64)
    up, down = _POWERS.get(len(raw))
    sums = np.empty(len(raw) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_VALUES[raw] * up, out=sums[1:])
    own = (sums[ends] - sums[starts]) * down[starts]
    return starts, ends, mix(own ^ (ends - starts).astype(np.uint64))


def _combined(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words."""
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        out += words[k : k + len(out)] * _FACTORS[n - k]
    return mix(out + np.uint64(n))


def shingle_hashes(words: np.ndarray, n: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """Hashes of the shingles of one text, in order, repeats included."""
    if not len(words):
        return words
    return _combined(words, min(n, len(words)))


def shingle_lists(texts: list[str | None], n: int = WORDS_PER_SHINGLE) -> Iterator[np.ndarray]:
    """The shingle hashes of each text, in order of the texts.

    Texts are joined into chunks of about CHUNK_BYTES, so many short ones cost
    a few array operations together. A text longer than that is its own chunk.
    """
    chunk: list[bytes] = []
    size = 0
    for text in texts:
        data = (text or "").encode()
        chunk.append(data)
        size += len(data) + 1
        if size >= CHUNK_BYTES:
            yield from _chunk_shingles(chunk, n)
            chunk, size = [], 0
    yield from _chunk_shingles(chunk, n)


def _chunk_shingles(chunk: list[bytes], n: int) -> Iterator[np.ndarray]:
    if not chunk:
        return
    starts, _, words = word_hashes(b"\n".join(chunk))
    ends = np.cumsum([len(data) + 1 for data in chunk])
    upto = np.searchsorted(starts, ends)
    runs = _combined(words, n) if len(words) >= n else None
    first = 0
    for last in upto.tolist():
        if last - first >= n:
            yield runs[first : last - n + 1]
        else:
            yield shingle_hashes(words[first:last], n)
        first = last
