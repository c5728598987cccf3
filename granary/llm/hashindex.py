"""Look-up of 64-bit keys in bulk, by open addressing in numpy."""

from __future__ import annotations

import numpy as np

_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class HashIndex:
    """Positions of distinct keys; ``find`` gives -1 for others."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.ascontiguousarray(keys, dtype=np.uint64)
        bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.mask, self.shift = np.int64((1 << bits) - 1), np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        left, at = np.arange(len(self.keys)), self._home(self.keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # the last of those that want a slot gets it
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _home(self, q: np.ndarray) -> np.ndarray:
        return ((q * _SPREAD) >> self.shift).astype(np.int64)

    def find(self, q: np.ndarray) -> np.ndarray:
        at = self._home(q)
        out = self.slots[at]
        if not len(self.keys):
            return out
        live = np.flatnonzero((out >= 0) & (self.keys[out] != q))
        at = at[live]
        while len(live):
            at = (at + 1) & self.mask
            got = self.slots[at]
            out[live] = got
            wrong = (got >= 0) & (self.keys[got] != q[live])
            live, at = live[wrong], at[wrong]
        return out


class Tally:
    """Counts of keys, kept small: yields merged (keys, counts) whenever ``limit`` keys have gathered."""

    def __init__(self, limit: int = 1 << 21):
        self.limit, self.parts, self.size = limit, [], 0

    def add(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > self.limit:
            merged = self.take()
            if len(merged[0]) > self.limit // 2:
                return merged
            self.parts, self.size = [merged], len(merged[0])
        return None

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """All that is left, merged."""
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, counts = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        self.parts, self.size = [], 0
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]
