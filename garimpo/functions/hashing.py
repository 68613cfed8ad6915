"""Hashes of any spans of a sequence, and places of a sequence brought together by key."""

from __future__ import annotations

import functools
import sys
from typing import NamedTuple

import numpy as np

_FIRST = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


@functools.cache
def numbers() -> np.ndarray:
    """A random number for each code point."""
    return mix(np.arange(sys.maxunicode + 1))


@functools.lru_cache(maxsize=1)
def _powers_to(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, _FIRST, np.uint64)
    down = np.full(size, np.uint64(pow(int(_FIRST), -1, 1 << 64)), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse, modulo 2^64."""
    up, down = _powers_to(max(1 << max(n - 1, 1).bit_length(), 1 << 21))
    return up[:n], down[:n]


class Prefix:
    """Hashes of any spans of a sequence of 64-bit numbers, from running sums of its members times powers."""

    def __init__(self, values: np.ndarray):
        up, self.down = _powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each span, 0 for empty ones."""
        key = (self.sums[end] - self.sums[start]) * self.down[start]
        return np.where(end > start, mix(key) | np.uint64(1), np.uint64(0))


class Places(NamedTuple):
    """Places of a sequence brought together by key, in order within each key."""

    place: np.ndarray
    same: np.ndarray  # for all but the last: the next place has the same key

    def times(self, n: int) -> np.ndarray:
        """How often each place's key occurs; 0 for places that were left out."""
        out = np.zeros(n, np.int64)
        if len(self.place):
            first = np.flatnonzero(np.append(True, ~self.same))
            size = np.diff(np.append(first, len(self.place)))
            out[self.place] = np.repeat(size, size)
        return out

    def near(self, n: int, reach: int) -> np.ndarray:
        """Places whose key stands again within ``reach`` places."""
        out = np.zeros(n, bool)
        close = self.same & (np.diff(self.place) <= reach)
        out[self.place[1:][close]] = True
        out[self.place[:-1][close]] = True
        return out


def together(key: np.ndarray, usable: np.ndarray) -> Places:
    """The usable places by key. One sort of numbers that hold a part of the key and the place."""
    place = np.flatnonzero(usable)
    if len(place) == 0:
        return Places(place, np.zeros(0, bool))
    low = np.uint64((1 << max(len(key) - 1, 1).bit_length()) - 1)
    made = key[place] & ~low | place.astype(np.uint64)
    made.sort()
    place = (made & low).astype(np.int64)
    full = key[place]
    return Places(place, full[1:] == full[:-1])
