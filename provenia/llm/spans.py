"""Vectorised work on UTF-8 text columns: word spans, XXH64 and sums by document.

All functions take plain numpy arrays: ``data`` holds the bytes of many texts one after
another and ``offsets`` says where each begins (one more than there are texts).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa

U = np.uint64
_P1, _P2, _P3, _P4, _P5 = (
    U(x)
    for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)

#: The white space of the contracts: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: ASCII lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def released() -> None:
    """Give free memory back to the system: Python workers stay while later stages run in the JVM beside them."""
    pa.default_memory_pool().release_unused()
    with suppress(Exception):
        ctypes.CDLL(None).malloc_trim(0)


def runs(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of texts that together hold at most ``limit`` bytes, a longer text alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        yield i, (j := min(max(j, i + 1), n))
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the words of all texts; first[d] is the number of the first word of text d."""
    space = np.empty(len(data) + 2, bool)
    space[0] = space[-1] = True
    space[1:-1] = SPACE[data]
    starts = np.flatnonzero(space[:-2] & ~space[1:-1])
    ends = np.flatnonzero(~space[1:-1] & space[2:]) + 1
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    cut = np.unique(inner[~space[inner] & ~space[inner + 1]])  # two texts that touch without white space
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, offsets)


def single_spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, ends) where exactly one space parts a word from the next."""
    size = ends - starts
    new = np.zeros(len(starts), np.int64)
    np.cumsum(size[:-1] + 1, out=new[1:])
    out = np.full(int(new[-1] + size[-1]) if len(new) else 0, 32, np.uint8)
    at = spread(size)
    out[np.repeat(new, size) + at] = data[np.repeat(starts, size) + at]
    return out, new, new + size


def spread(counts: np.ndarray) -> np.ndarray:
    """0 .. counts[0]-1, 0 .. counts[1]-1, and so on."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) - np.repeat(before, counts)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each span of bytes, as uint64."""
    n = len(starts)
    if not n:
        return np.zeros(0, U)
    pad = np.zeros((len(data) + 23) // 8 * 8, np.uint8)
    pad[: len(data)] = data
    wide = pad.view("<u8")

    def lane(at: np.ndarray) -> np.ndarray:
        q, s = at >> 3, ((at & 7) << 3).astype(U)
        return (wide[q] >> s) | ((wide[q + 1] << U(1)) << (U(63) - s))

    at, size = starts.astype(np.int64), (ends - starts).astype(np.int64)
    with np.errstate(over="ignore"):
        h = np.full(n, U(seed) + _P5, U)
        if len(big := np.flatnonzero(size >= 32)):
            pos, acc = at[big].copy(), [np.full(len(big), U(seed) + x, U) for x in (_P1 + _P2, _P2, U(0))]
            acc.append(np.full(len(big), U(seed) - _P1, U))
            left = size[big] // 32
            while len(go := np.flatnonzero(left > 0)):
                for k in range(4):
                    acc[k][go] = _round(acc[k][go], lane(pos[go] + 8 * k))
                pos[go] += 32
                left[go] -= 1
            x = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for a in acc:
                x = (x ^ _round(np.zeros_like(a), a)) * _P1 + _P4
            h[big] = x
            at[big] = pos
        h += size.astype(U)
        rest = size & 31
        for k in range(3):
            if k and not len(go := np.flatnonzero(rest >= 8)):
                break
            go = go if k else np.flatnonzero(rest >= 8)
            if not len(go):
                break
            h[go] = _rotl(h[go] ^ _round(np.zeros(len(go), U), lane(at[go])), 27) * _P1 + _P4
            at[go] += 8
            rest[go] -= 8
        if len(go := np.flatnonzero(rest >= 4)):
            h[go] = _rotl(h[go] ^ ((lane(at[go]) & U(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
            at[go] += 4
            rest[go] -= 4
        for _ in range(3):
            if not len(go := np.flatnonzero(rest > 0)):
                break
            h[go] = _rotl(h[go] ^ (pad[at[go]].astype(U) * _P5), 11) * _P1
            at[go] += 1
            rest[go] -= 1
        h ^= h >> U(33)
        h *= _P2
        h ^= h >> U(29)
        h *= _P3
        h ^= h >> U(32)
    return h


def sums(values: np.ndarray, first: np.ndarray, dtype: type = np.float64) -> np.ndarray:
    """Sum of values[first[d]:first[d + 1]] for each d, rows of a matrix likewise."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), dtype)
    some = np.flatnonzero(first[1:] > first[:-1])
    if len(some):
        out[some] = np.add.reduceat(values, first[some], axis=0, dtype=dtype)
    return out
