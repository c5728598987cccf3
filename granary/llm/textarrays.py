"""Words and hashes of whole batches of texts as numpy arrays.

A chunk of texts becomes one byte array with a newline before, between and after the texts, so that
word boundaries, hashes and windows come from a handful of vector operations. Hashes have 64 bits;
among n distinct words about n*n/2**65 pairs are expected to collide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words of everything but ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Words of digits, a to z and all that is not ASCII, after lower-casing.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_LONG = 48


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text, or of one row."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    lo = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


class Texts:
    """The bytes of some texts, lower-cased (A-Z) on request, and where each begins. A null is empty."""

    def __init__(self, column: pa.Array, lower: bool = True):
        values = [v or b"" for v in column.cast(pa.binary()).to_pylist()]
        flat = np.frombuffer(b"\n" + b"\n".join(values) + b"\n", dtype=np.uint8)
        self.flat = LOWER[flat] if lower else flat
        self.sizes = np.fromiter(map(len, values), np.int64, len(values))
        self.starts = 1 + np.concatenate(([0], np.cumsum(self.sizes + 1)[:-1])) if len(values) else np.zeros(0, np.int64)

    def words(self, kind: np.ndarray = SPACED) -> Words:
        return Words(self, kind)


class Words:
    """Byte ranges of all words of a chunk, and the range of words of each text."""

    def __init__(self, texts: Texts, kind: np.ndarray):
        self.flat = texts.flat
        turn = np.diff(kind[texts.flat].view(np.int8))
        self.start = np.flatnonzero(turn == 1) + 1
        self.end = np.flatnonzero(turn == -1) + 1
        self.first = np.searchsorted(self.start, texts.starts)
        self.last = np.append(self.first[1:], len(self.start)) if len(self.first) else self.first

    @property
    def counts(self) -> np.ndarray:
        return self.last - self.first

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first)), self.counts)

    def hashes(self) -> np.ndarray:
        length = self.end - self.start
        h = length.astype(np.uint64) * _STEP
        live = np.flatnonzero(length <= _LONG)
        for k in range(_LONG):
            live = live[length[live] > k]
            if not len(live):
                break
            h[live] = (h[live] ^ self.flat[self.start[live] + k]) * _M1 + _STEP
        for i in np.flatnonzero(length > _LONG).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.flat[self.start[i] : self.end[i]].tobytes(), digest_size=8).digest(), "little")
        return mix(h)


def sequence_hash(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` entries of h, one for each start."""
    n = max(0, len(h) - width + 1)
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out = mix(out * _STEP + h[k : k + n])
    return out
