"""Hashes of byte and word runs of a text, for all positions at once.

A run's hash is a polynomial over 64-bit values modulo 2**64, taken from prefix sums;
bytes stand for random values, and results are mixed.  Equal runs have equal hashes.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Runs:
    """Prefix sums over a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        power, self.inverse = _power_tables(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(values * power[: self.n], out=self.sums[1:])

    def between(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])

    def windows(self, width: int) -> np.ndarray:
        """Hash of the run of ``width`` values at every position."""
        count = max(0, self.n - width + 1)
        return mix((self.sums[width : width + count] - self.sums[:count]) * self.inverse[:count])


def byte_runs(text: bytes) -> Runs:
    return Runs(_BYTES[np.frombuffer(text, np.uint8)])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last byte of the words ``[^\\x20\\x09-\\x0D]+``."""
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = ~_SPACE[np.frombuffer(text, np.uint8)]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds and hashes of all words."""
    starts, ends = word_bounds(text)
    return starts, ends, byte_runs(text).between(starts, ends)
