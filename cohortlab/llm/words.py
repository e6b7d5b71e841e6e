"""Whole-column word splitting and rolling hashes over Arrow text, vectorised with numpy.

Both word patterns of the operators put every separator in ASCII and every non-ASCII character
inside words, so UTF-8 bytes can be classified one by one. A batch is cut into pieces of a bounded
number of bytes (one text at least), which bounds memory whatever the texts' lengths; no text is cut.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
PIECE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: `[^\x20\x09-\x0D]+`
SPACED = np.ones(256, dtype=bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: digits, a-z and all non-ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (bijective)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def inverse(b: int) -> int:
    return pow(b, -1, 1 << 64)


class Roll:
    """Hashes of slices of a sequence: a polynomial in an odd base over prefix sums modulo 2**64."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1, 1 << 62)) * 8 + 5
        self.byte = rng.integers(0, 1 << 63, 256, dtype=np.int64).view(U) * U(2) + U(1)
        self._powers = np.ones(1, dtype=U)
        self._inverses = np.ones(1, dtype=U)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self._powers):
            n = max(n, 2 * len(self._powers))
            steps = np.full(n, self.base % (1 << 64), dtype=U)
            steps[0] = 1
            self._powers = np.multiply.accumulate(steps)
            steps = np.full(n, inverse(self.base), dtype=U)
            steps[0] = 1
            self._inverses = np.multiply.accumulate(steps)
        return self._powers, self._inverses

    def slices(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(values)
        power, inv = self.powers(n + 1)
        sums = np.zeros(n + 1, dtype=U)
        np.cumsum(values * power[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inv[starts])

    def windows(self, values: np.ndarray, k: int) -> np.ndarray:
        """Hash of values[i:i+k] for every i that has k values."""
        n = len(values) - k + 1
        if n <= 0:
            return np.empty(0, dtype=U)
        out = values[:n].copy()
        for j in range(1, k):
            out *= U(self.base % (1 << 64))
            out += values[j : j + n]
        return mix(out)


WORD, GRAM = Roll(11), Roll(23)


@dataclass
class Piece:
    """Some whole texts of a batch: row numbers, and their words in order."""

    first: int  # row of the batch
    rows: int
    data: np.ndarray  # bytes, folded if asked for
    offsets: np.ndarray  # of the texts in data
    starts: np.ndarray  # of the words in data
    ends: np.ndarray
    row: np.ndarray  # of each word, from 0
    count: np.ndarray  # words of each row
    begin: np.ndarray  # first word of each row; one more at the end

    def hashes(self, roll: Roll = WORD) -> np.ndarray:
        return roll.slices(roll.byte[self.data], self.starts, self.ends)

    def place(self) -> np.ndarray:
        """Number of each word within its text."""
        return np.arange(len(self.row)) - self.begin[self.row]


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if large else np.int32
    _, off, data = texts.buffers()
    if off is None or len(texts) == 0:
        return np.empty(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    offsets = np.frombuffer(off, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    return whole, offsets


def cuts(offsets: np.ndarray, most: int = PIECE_BYTES, rows: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes and ``rows`` rows, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), i + rows, n)
        yield i, j
        i = j


def pieces(texts: pa.Array, inside: np.ndarray = SPACED, fold: bool = False, most: int = PIECE_BYTES) -> Iterator[Piece]:
    whole, offsets = text_buffers(texts)
    for i, j in cuts(offsets, most):
        data = whole[offsets[i] : offsets[j]]
        if fold:
            data = _LOWER[data]
        off = offsets[i : j + 1] - offsets[i]
        starts, ends = bounds(inside[data], off)
        row = np.searchsorted(off, starts, side="right") - 1
        count = np.bincount(row, minlength=j - i)
        begin = np.zeros(j - i + 1, dtype=np.int64)
        np.cumsum(count, out=begin[1:])
        yield Piece(i, j - i, data, off, starts, ends, row, count, begin)


def bounds(word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True that don't cross a text's border."""
    if not len(word):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    border = np.zeros(len(word) + 1, dtype=bool)
    border[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | border[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | border[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def same_row(row: np.ndarray, k: int) -> np.ndarray:
    """For each start of k words: do they lie in one text?"""
    n = len(row) - k + 1
    return row[:n] == row[k - 1 :] if n > 0 else np.empty(0, dtype=bool)


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Boolean mask of the n positions that lie in some [start, start + k)."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + k, n), -1)
    return np.cumsum(step[:n]) > 0
