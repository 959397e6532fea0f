"""Vectorised text primitives shared by the operators of this subpackage.

Everything works on whole Arrow batches: texts are one UTF-8 buffer plus
offsets, words and windows are index arrays, and hashes are 64-bit numpy
arrays.  No per-word Python loop runs anywhere.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D.  Hashes are
polynomial over a fixed random byte table modulo 2**64, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
LOWER_TABLE = BYTE_TABLE.copy()
LOWER_TABLE[65:91] = BYTE_TABLE[97:123]
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that are worked on at a time; bounds the worker's memory.
STEP_BYTES = 2_000_000
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, STEP_BYTES + 65_536)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; bijective."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(data: np.ndarray, offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; one longer text is a range alone."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, min(end, n)
        row = end


def sub(data: np.ndarray, offsets: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    return data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n+1 offsets of the texts into them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~space[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] |= solid[inner]  # a text's end ends a word too
    last[inner - 1] |= solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE_TABLE) -> np.ndarray:
    """A 64-bit hash of each byte range, equal for equal bytes."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(BASE, len(data)), out=total[1:])
    out = total[ends]
    out -= total[starts]
    out *= powers(INVERSE, len(data) + 1)[starts]
    out += (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93)
    return mix(out)


def hash_windows(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` consecutive 64-bit values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=total[1:])
    out = total[width:] - total[:-width]
    out *= powers(INVERSE, n)
    return mix(out + _U(width))


def window_rows(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows that lie in one text, and each one's text."""
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(offsets[:-1], counts)
    return start, text


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The leftmost least value's index in each run of `width` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, have = np.arange(len(values)), 1
    while have * 2 <= width:
        a, b = best[:-have], best[have:]
        best, have = np.where(values[b] < values[a], b, a), have * 2
    if have < width:
        a, b = best[: len(best) - (width - have)], best[width - have :]
        best = np.where(values[b] < values[a], b, a)
    return best[:n]


def as_long(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def utf8_like(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of a binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]
