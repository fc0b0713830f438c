"""Words and word n-grams of a whole Arrow column of texts as flat numpy arrays.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return; A-Z count as a-z. Words are never built as strings: each is a 64-bit polynomial hash of
its bytes, taken from running sums over the column's buffer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U64 = np.uint64
_BASE = _U64(0x9E3779B97F4A7C15)
_INVERSE = _U64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _classes() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A") : ord("Z") + 1] += 32
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return lower, space


_LOWER, _SPACE = _classes()
_VALUE = _LOWER.astype(_U64) + _U64(1)
_CASED_VALUE = np.arange(1, 257, dtype=_U64)
#: Bytes that end a word where punctuation counts as a separator too: ASCII other than 0-9, A-Z, a-z.
_PUNCTUATION = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_IN_WORD, _IN_PLAIN_WORD = ~_SPACE, ~_PUNCTUATION


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


@dataclass
class Words:
    """Words in order: hash, first byte and end byte of each, and bounds[d]:bounds[d + 1] those of row d."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of ``size`` words and the bounds of each row's.

        A row with fewer words has its whole sequence as one; a row without words has none.
        """
        counts = self.counts
        made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
        bounds = np.r_[0, np.cumsum(made)]
        width = np.minimum(counts, size)
        first = np.repeat(self.bounds[:-1] - bounds[:-1], made) + np.arange(bounds[-1])
        span = np.repeat(width, made)
        mixed = mix(self.hash)
        total = mix(span.astype(_U64) + _U64(0x51ED270B))
        for k in range(size):
            inside = span > k
            at = np.where(inside, first + k, 0)
            step = total * _BASE + (mixed[at] if len(mixed) else _U64(0))
            total = np.where(inside, step, total)
        return mix(total), bounds


def row_chunks(column: pa.Array, max_bytes: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets of successive rows that hold about ``max_bytes`` together.

    Working by chunks keeps the arrays in cache and bounds memory; a longer text is its own chunk.
    """
    data, offsets = text_buffer(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + max_bytes, side="right")) - 1)
        own = offsets[row : stop + 1]
        yield row, data[own[0] : own[-1]], own - own[0]
        row = stop


def words_of(column: pa.Array, split_punctuation: bool = False) -> Words:
    """The words of every row of a string column, at once."""
    data, offsets = text_buffer(column)
    return words_in(data, offsets, split_punctuation)


_powers = [np.ones(1, _U64), np.ones(1, _U64)]


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, 0 to n at least; the same for every text."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _INVERSE)):
            _powers[k] = np.full(n + 1, base, _U64)
            _powers[k][0] = 1
            np.cumprod(_powers[k], out=_powers[k])
    return _powers


def words_in(data: np.ndarray, offsets: np.ndarray, split_punctuation: bool = False, fold_case: bool = True) -> Words:
    """The words of the rows ``data[offsets[i]:offsets[i + 1]]``, which follow each other without gaps."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, _U64), none, none, np.zeros(len(offsets), np.int64), data)
    inside = (_IN_PLAIN_WORD if split_punctuation else _IN_WORD)[data]
    before = np.r_[False, inside[:-1]]
    before[offsets[:-1][offsets[:-1] < n]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.r_[inside[1:], False]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    power, inverse = _powers_to(n)
    sums = np.zeros(n + 1, _U64)
    np.cumsum((_VALUE if fold_case else _CASED_VALUE)[data] * power[:n], out=sums[1:])
    hashed = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(_U64) * _U64(0xD6E8FEB86659FD93))
    return Words(hashed, start, end, np.searchsorted(start, offsets), data)
