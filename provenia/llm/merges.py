"""Score-ordered agendas of adjacent symbol pairs, many chunks side by side."""

from __future__ import annotations

import heapq

import numpy as np

_LONG = 128
#: So many different chunks share one comparison with a library: those whose hash it divides.
CHECKED = 64
_NONE = np.int32(2**31 - 1)
_EMPTY = np.int64(-1)


class PairTable:
    """Open-addressed hash table from symbol pairs to (order, merged symbol); vectorised lookup."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]) -> None:
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, _EMPTY, np.int64)
        self.order = np.full(1 << bits, _NONE, np.int32)
        self.merged = np.full(1 << bits, -1, np.int32)
        key = np.array([a << 32 | b for a, b in pairs], np.int64)
        order, merged = (np.array([v[k] for v in pairs.values()], np.int32) for k in (0, 1))
        at, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = left[self.keys[at[left]] == _EMPTY]
            _, one = np.unique(at[free], return_index=True)  # one newcomer for each free slot
            put = free[one]
            self.keys[at[put]], self.order[at[put]], self.merged[at[put]] = key[put], order[put], merged[put]
            left = left[self.keys[at[left]] != key[left]]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, merged symbol); order is _NONE where the pair forms nothing or b is -1."""
        key = a.astype(np.int64) << 32 | (b.astype(np.int64) & 0xFFFFFFFF)
        at = self._slot(key)
        found = self.keys[at]
        todo = np.flatnonzero((found != key) & (found != _EMPTY))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            now = self.keys[at[todo]]
            todo = todo[(now != key[todo]) & (now != _EMPTY)]
        hit = (self.keys[at] == key) & (b >= 0) & (a >= 0)
        return np.where(hit, self.order[at], _NONE), self.merged[at]

    def get(self, a: int, b: int) -> tuple[int, int] | None:
        """(order, merged symbol) of one pair; None where it forms nothing."""
        key = a << 32 | b
        at = ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
        while (found := self.keys.item(at)) != key:
            if found == -1:
                return None
            at = (at + 1) & self.mask
        return self.order.item(at), self.merged.item(at)


def heap_agenda(symbols: list[int], table: PairTable) -> list[int]:
    """The agenda of one chunk with a heap: O(n log n) for chunks of any length."""
    n = len(symbols)
    s, after, before = list(symbols), [*range(1, n), -1], list(range(-1, n - 1))
    agenda: list[tuple[int, int, int, int]] = []

    def add(i: int) -> None:
        j = after[i]
        if j >= 0 and (hit := table.get(s[i], s[j])):
            heapq.heappush(agenda, (hit[0], i, s[i], s[j]))

    for i in range(n - 1):
        add(i)
    while agenda:
        _, i, a, b = heapq.heappop(agenda)
        j = after[i] if s[i] == a else -1
        if j < 0 or s[j] != b:
            continue
        s[i], s[j] = table.get(a, b)[1], -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        add(i)
        if before[i] >= 0:
            add(before[i])
    return [x for x in s if x >= 0]


def side_by_side(symbols: np.ndarray, first: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Agendas of many chunks symbols[first[c]:first[c + 1]]; (merged symbols, first of each chunk)."""
    size = np.diff(first)
    out = symbols.copy()
    alive = np.ones(len(symbols), bool)
    for c in np.flatnonzero(size > _LONG).tolist():
        done = heap_agenda(symbols[first[c] : first[c + 1]].tolist(), table)
        out[first[c] : first[c] + len(done)] = done
        alive[first[c] + len(done) : first[c + 1]] = False
    edges = [1, 2, 4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, _LONG]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        group = np.flatnonzero((size > lo) & (size <= hi))
        for k in range(0, len(group), (1 << 19) // hi):
            some = group[k : k + (1 << 19) // hi]
            col = np.arange(hi)
            at = first[some][:, None] + col
            inside = col < size[some][:, None]
            s = np.where(inside, symbols[np.minimum(at, len(symbols) - 1)], -1).astype(np.int32)
            nxt = np.where(col + 1 < size[some][:, None], col + 1, hi).astype(np.int16)
            prv = np.broadcast_to(np.where(col > 0, col - 1, hi), s.shape).astype(np.int16).copy()
            order = np.full((len(some), hi + 1), _NONE, np.int32)
            o, m = table.look(s[:, :-1].ravel(), s[:, 1:].ravel())
            order[:, : hi - 1] = o.reshape(-1, hi - 1)
            into = np.full((len(some), hi + 1), -1, np.int32)
            into[:, : hi - 1] = m.reshape(-1, hi - 1)
            s = np.concatenate([s, np.full((len(some), 1), -1, np.int32)], axis=1)  # column hi: no neighbour
            nxt = np.concatenate([nxt, np.full((len(some), 1), hi, np.int16)], axis=1)
            prv = np.concatenate([prv, np.full((len(some), 1), hi, np.int16)], axis=1)
            rows = np.arange(len(some))
            while len(rows):
                best = order[rows].argmin(axis=1)
                go = order[rows, best] < _NONE
                rows, i = rows[go], best[go]
                if not len(rows):
                    break
                j = nxt[rows, i]
                s[rows, i] = into[rows, i]
                s[rows, j] = -1
                order[rows, j] = _NONE
                k2 = nxt[rows, j]
                nxt[rows, i] = k2
                prv[rows, k2] = i
                p = prv[rows, i]
                for left, right in ((i, k2), (p, i)):
                    o, m = table.look(s[rows, left], s[rows, right])
                    order[rows, left], into[rows, left] = o, m
                order[rows, hi] = _NONE
            s = s[:, :hi]
            out[at[inside]] = s[inside]
            alive[at[inside]] = s[inside] >= 0
    kept = np.concatenate([[0], np.cumsum(alive)])[first]
    return out[alive], kept


class Memory:
    """Merged symbols of chunks met before, by the hash and size of their bytes; of fixed size, newest entries win."""

    def __init__(self, bits: int = 20, symbols: int = 1 << 22) -> None:
        self.shift = np.uint64(64 - bits)
        self.keys, self.sizes = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self.starts, self.counts = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int32)
        self.flat, self.used, self.room = np.zeros(symbols, np.int32), 0, symbols

    def find(self, h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chunks to be merged, which of them stands for each unknown chunk).

        Makes room first, so what is known stays until ``complete``.
        """
        if self.used > self.room // 2:
            self.keys[:] = 0
            self.used = 0
        at = (h >> self.shift).astype(np.int64)
        self.new = np.flatnonzero((self.keys[at] != h) | (self.sizes[at] != size) | (h == 0))
        _, one, of = np.unique(h[self.new], return_index=True, return_inverse=True)
        if (size[self.new] != size[self.new[one]][of]).any():  # hashes collide
            one = of = np.arange(len(self.new))
        return self.new[one], of

    def complete(self, h: np.ndarray, size: np.ndarray, fresh: np.ndarray, of: np.ndarray, merged: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, start, count) of all chunks, where merged and first give those that ``find`` named."""
        end = self.used + len(merged)
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(2 * len(merged), np.int32)])
        self.flat[self.used : end] = merged
        at = (h >> self.shift).astype(np.int64)
        start, count = self.starts[at], self.counts[at].astype(np.int64)
        head, many = self.used + first[:-1], np.diff(first)
        start[self.new], count[self.new] = head[of], many[of]
        put = at[fresh]
        self.keys[put], self.sizes[put], self.starts[put], self.counts[put] = h[fresh], size[fresh], head, many
        self.used = end
        return self.flat, start, count
