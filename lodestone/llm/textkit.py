"""Array kernels over the UTF-8 bytes of many texts at once: words, their hashes and hashes of word windows.

A word is a run of ASCII digits, ASCII letters (lower-cased) and characters beyond ASCII; on UTF-8 bytes that is a run
of bytes from 0-9, a-z and 0x80-0xFF.  Hashes are 64-bit polynomials, read off prefix sums, so that each word and each
window costs a constant number of array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
CHUNK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[65:91] = WORD_BYTE[128:] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= CHUNK_BYTES + 1:
            _powers[base] = have
    return have[:n]


def forget() -> None:
    """Drops what is kept between calls."""
    _powers.clear()


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(29))
    x = x * U64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> U64(32))


def sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values, out=out[1:])
    return out


def as_string(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a large_string array, and the offsets of each text in them."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, dtype=np.uint8), at - at[0] if len(at) else np.zeros(1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive rows of about `most` bytes together (one text at least), so that array temporaries stay small."""
    if not len(column):
        return
    _, at = raw(column)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(at, at[start] + most, side="right")) - 1)
        yield start, column.slice(start, stop - start)
        start = stop


class Words:
    """The words of a slice of texts: byte spans, hashes, and where each text's words begin."""

    def __init__(self, column: pa.Array):
        data, self.at = raw(column)
        self.data = LOWER[data]
        word = WORD_BYTE[data]
        before = np.empty_like(word)
        before[1:], before[:1] = word[:-1], False
        inner = self.at[:-1][self.at[:-1] < len(data)]
        before[inner] = False
        begins = word & ~before
        after = np.empty_like(word)
        after[:-1], after[-1:] = word[1:], False
        last = self.at[1:] - 1
        after[last[last >= 0]] = False
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, self.at)  # of each text, and one past the last
        n = len(data)
        prefix = sums((self.data.astype(U64) + U64(1)) * powers(BYTE_BASE, n)) if n else np.zeros(1, dtype=U64)
        self.hash = mix((prefix[self.end] - prefix[self.start]) * powers(inverse(BYTE_BASE), n)[self.start]) if n else np.zeros(0, dtype=U64)
        self._prefix: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of `size` consecutive words of one text, and the index of each window's first word."""
        n = len(self.hash)
        if n < size:
            return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
        if self._prefix is None:
            self._prefix = sums(self.hash * powers(WORD_BASE, n))
        p = self._prefix
        hashes = mix((p[size:] - p[:-size]) * powers(inverse(WORD_BASE), n)[: n - size + 1] + U64(size))
        inside = np.ones(n - size + 1, dtype=bool)
        for k in range(1, size):  # a window may not cross the end of a text
            cut = self.first[1:-1] - k
            inside[cut[(cut >= 0) & (cut < len(inside))]] = False
        where = np.flatnonzero(inside)
        return hashes[where], where

    def text_of(self, word: np.ndarray) -> np.ndarray:
        """The index of the text that holds each word."""
        return np.searchsorted(self.first, word, side="right") - 1
