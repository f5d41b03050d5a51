"""Vectorised text kernels over Arrow string columns.

All of them see the UTF-8 bytes of many documents at once, in pieces of bounded
size, and never cut a document. Words are the runs of bytes that the class below
takes: ASCII digits and letters (lower-cased) and every byte above 0x7F, which is
`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` over lower-cased text, as no multi-byte
character has a byte below 0x80.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2 << 20


def _table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.zeros(256, dtype=bool)
    word[48:58] = word[97:123] = word[65:91] = True
    word[128:] = True
    values = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return lower, word, values[lower]


LOWER, WORD, VALUE = _table()
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse, i < n, modulo 2**64."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    a, b = np.full(n, BASE, dtype=np.uint64), np.full(n, inverse, dtype=np.uint64)
    if n:
        a[0] = b[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(a, dtype=np.uint64), np.cumprod(b, dtype=np.uint64)


class Powers:
    """powers(), kept and grown as pieces need."""

    def __init__(self, most: int = PIECE_BYTES):
        self.a, self.b = powers(most + 1)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.a):
            self.a, self.b = powers(n + (n >> 2))
        return self.a, self.b


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not wide and not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.large_string())
        wide = True
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offs[0] : offs[-1]], offs - offs[0]


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) with at most `most` bytes, or one longer document."""
    data, offs = buffers(column)
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


class Words:
    """The words of a piece: starts, ends (bytes), doc (row in the piece), hash."""

    __slots__ = ("starts", "ends", "doc", "hash", "first", "n_docs")

    def __init__(self, data: np.ndarray, offs: np.ndarray, pows: Powers):
        self.n_docs = len(offs) - 1
        is_word = WORD[data]
        n = len(data)
        begin, end = is_word.copy(), is_word.copy()
        if n:
            begin[1:] &= ~is_word[:-1]
            end[:-1] &= ~is_word[1:]
            cut = offs[1:-1]
            cut = cut[(cut > 0) & (cut < n)]
            begin[cut] = is_word[cut]
            end[cut - 1] = is_word[cut - 1]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        # first[i]: number of words before document i
        self.first = np.searchsorted(self.starts, offs).astype(np.int64)
        self.doc = np.repeat(np.arange(self.n_docs, dtype=np.int64), np.diff(self.first))
        a, b = pows.upto(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(VALUE[data] * a[:n], out=sums[1:])
            self.hash = mix64((sums[self.ends] - sums[self.starts]) * b[self.starts])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position; the last k-1 positions are dropped."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for j in range(1, k):
            out = out * MULTIPLIER + hashes[j : j + n]
        return mix64(out)


def sliding(values: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each w neighbouring values, in log(w) passes."""
    n = len(values) - w + 1
    if n <= 0:
        return values[:0]
    out, span = values, 1
    while span * 2 <= w:
        out = pick(out[:-span], out[span:])
        span *= 2
    if span < w:
        shift = w - span
        out = pick(out[: len(out) - shift], out[shift:])
    return out


def word_bytes(data: np.ndarray, start: int, end: int) -> bytes:
    return LOWER[data[start:end]].tobytes()
