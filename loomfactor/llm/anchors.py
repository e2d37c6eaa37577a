"""Content-defined anchors of sequences: which windows of a fixed length can be found elsewhere at all.

A sequence is an array of unsigned 64-bit symbols (bytes or hashes of words). Every window of ``window`` symbols
names as its anchor the rightmost of its ``gram``-grams with the smallest hash. The choice depends on the
window's own symbols only, so equal windows have equal anchors at equal offsets. A run of consecutive windows
that share an anchor is one segment: the unit that is counted, shuffled and compared.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
#: One fixed random number for each byte value.
BYTE_SYMBOLS = np.random.default_rng(2024).integers(1, 2**64, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _BASE
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any stretch of a sequence in constant time: a polynomial in an odd base, modulo 2**64."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        powers = np.full(n + 1, _BASE)
        powers[0] = 1
        self.powers = np.cumprod(powers, dtype=np.uint64)
        self.inverse = None
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(symbols * self.powers[:n], dtype=np.uint64)))

    def hashes(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        if self.inverse is None:
            inverse = np.full(len(self.powers), _INVERSE)
            inverse[0] = 1
            self.inverse = np.cumprod(inverse, dtype=np.uint64)
        return mix((self.sums[start + length] - self.sums[start]) * self.inverse[start])


def _rightmost_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of width hashes, the place of its smallest one, the rightmost of equals. By doubling."""
    best = np.arange(len(h))
    span = 1
    while span < width:
        step = min(span, width - span)
        left, right = best[:-step], best[step:]
        best = np.where(h[right] <= h[left], right, left)
        span += step
    return best


def segments(symbols: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(key, start, windows, anchor, content) of each segment: the hash of its anchor's gram together with the
    anchor's offset, the first window, the number of windows, the anchor's place, and the hash of all its symbols."""
    if len(symbols) < window:
        none = np.zeros(0, np.uint64)
        return none, none.astype(np.int64), none.astype(np.int64), none.astype(np.int64), none
    rolling = Rolling(symbols)
    h = rolling.hashes(np.arange(len(symbols) - gram + 1), gram)
    at = _rightmost_minimum(h, window - gram + 1)
    start = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    count = np.diff(np.append(start, len(at)))
    anchor = at[start]
    return h[anchor], start, count, anchor, rolling.hashes(start, count + window - 1)
