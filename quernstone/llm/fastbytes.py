"""Hashes of words and shingles of a text, computed over whole numpy arrays."""

from __future__ import annotations

import numpy as np

#: An odd multiplier and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SHINGLE_BASE = 0xC2B2AE3D27D4EB4F

_rng = np.random.default_rng(20240607)
#: A random value for each byte, A-Z as a-z.
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
BYTE_VALUE[0x41:0x5B] = BYTE_VALUE[0x61:0x7B]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class PowerTable:
    """Powers of BASE and its inverse, grown when a longer text comes."""

    def __init__(self):
        self.grow(1 << 14)

    def grow(self, n: int) -> None:
        self.up, self.down = powers(BASE, n), powers(BASE_INVERSE, n)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.grow(1 << (n - 1).bit_length())
        return self.up[:n], self.down[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes, table: PowerTable) -> np.ndarray:
    """A 64-bit hash for each word, a run of bytes that are no white space."""
    if not raw:
        return np.empty(0, np.uint64)
    data = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(IS_SPACE[data], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = table.of(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up, out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(raw: bytes, n: int, table: PowerTable) -> np.ndarray:
    """The sorted distinct hashes of n-word shingles; fewer words, but not none,
    are one shingle."""
    words = word_hashes(raw, table)
    if not len(words):
        return words
    size = min(n, len(words))
    count = len(words) - size + 1
    total = np.zeros(count, np.uint64)
    for i in range(size):
        total = total * np.uint64(SHINGLE_BASE) + words[i : i + count]
    total = np.sort(mixed(total + np.uint64(size)))  # faster than np.unique here
    return total[np.concatenate(([True], total[1:] != total[:-1]))]
