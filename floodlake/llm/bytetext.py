"""Vectorised word and shingle hashing over Arrow string columns.

The kernels work on the UTF-8 bytes of many texts at once, so a task spends
its time in numpy and never in a Python loop over words.  Texts are taken in
slices of about ``SLICE`` bytes (one longer text makes a slice of its own),
which bounds the memory of a task whatever the Arrow batch size is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one kernel call takes at most, unless one text is longer.
SLICE = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of letter-and-digit words: ASCII other than digits and letters.
_NOT_ALNUM = np.zeros(256, dtype=bool)
_NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
#: Separators of letter words: ASCII other than letters.
_NOT_ALPHA = np.zeros(256, dtype=bool)
_NOT_ALPHA[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE) | np.uint64(1)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE + 1)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse)]), dtype=np.uint64)
        return self.up[:n], self.down[:n]


_powers = _Powers()


@dataclass
class Words:
    """Words of some consecutive texts: byte spans, and ``first[i]:first[i + 1]`` for text i."""

    row: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    text: np.ndarray

    @property
    def n_texts(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.n_texts), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.data)
        up, down = _powers.of(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[self.data] * up[:n], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start])

    def prefixes(self, length: int) -> np.ndarray:
        """A hash of each word's first bytes, differing by ``length``; shorter words count whole."""
        n = len(self.data)
        up, down = _powers.of(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[self.data] * up[:n], out=total[1:])
        end = np.minimum(self.end, self.start + length)
        return mix(((total[end] - total[self.start]) * down[self.start]) ^ np.uint64(int(_STEP) * length % (1 << 64)))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def parts(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The UTF-8 bytes of a string column in slices, as (first row, bytes, offsets of its texts); null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offset = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offset, offset[row] + SLICE, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield row, raw[offset[row] : offset[stop]], offset[row : stop + 1] - offset[row]
        row = stop


def slices(column: pa.Array | pa.ChunkedArray, *, lower: bool = False, alnum: bool = False, alpha: bool = False) -> Iterator[Words]:
    """Tokenise a string column; null counts as the empty text.

    Words are runs of bytes other than ASCII white space; with ``alnum``, runs
    of ASCII letters, digits and non-ASCII bytes, with ``alpha`` without digits.
    ``lower`` folds A-Z alone.
    """
    gap = _NOT_ALPHA if alpha else _NOT_ALNUM if alnum else _SPACE
    for row, part, text in parts(column):
        yield _split(row, _LOWER[part] if lower else part, text, gap)


def _split(row: int, data: np.ndarray, text: np.ndarray, gap: np.ndarray) -> Words:
    n = len(data)
    inside = ~gap[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[text] = True
    before = np.ones(n, dtype=bool)
    before[1:] = ~inside[:-1]
    after = np.ones(n, dtype=bool)
    after[:-1] = ~inside[1:]
    start = np.flatnonzero(inside & (before | cut[:n]))
    end = np.flatnonzero(inside & (after | cut[1:])) + 1
    return Words(row, data, start, end, np.searchsorted(start, text), text)


def join_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a pair of hashes, order counting."""
    return mix(left * _STEP + (right ^ _BASE) * _BASE)


def shingle(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position; the last k - 1 positions are dropped."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out += words[j : j + n] * np.uint64(pow(int(_STEP), j, 1 << 64))
    return mix(out + np.uint64(k))


def window_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which k words of one text begin, and how many each text has."""
    size = np.maximum(np.diff(first) - k + 1, 0)
    if not size.sum():
        return np.zeros(0, dtype=np.int64), size
    jump = np.repeat(first[:-1] - (np.cumsum(size) - size), size)
    return np.arange(size.sum()) + jump, size


class Lookup:
    """Finds 64-bit keys in a fixed set: buckets by the leading bits, then a few vectorised steps."""

    def __init__(self, keys: np.ndarray) -> None:
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        bits = min(22, max(4, int(len(keys)).bit_length() + 2))
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.steps = int(np.diff(self.first).max()) if len(keys) else 0

    def original(self) -> np.ndarray:
        """The keys in the order given."""
        out = np.empty_like(self.keys)
        out[self.order] = self.keys
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key in the set as given, or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        if not len(self.keys):
            return out
        bucket = (keys >> self.shift).astype(np.int64)
        at, stop = self.first[bucket], self.first[bucket + 1]
        left = np.flatnonzero(at < stop)
        for step in range(self.steps):
            place = at[left] + step
            hit = self.keys[place] == keys[left]
            out[left[hit]] = self.order[place[hit]]
            left = left[~hit]
            left = left[at[left] + step + 1 < stop[left]]
            if not len(left):
                break
        return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
