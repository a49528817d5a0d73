"""Words of a text as arrays: where they start and end, their hashes and their lines."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown when a longer text comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


powers = Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of slices of one sequence, from prefix sums of values times powers."""

    def __init__(self, values: np.ndarray) -> None:
        self.up, self.down = powers.upto(len(values) + 1)
        self.total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.up[: len(values)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))


class Words(NamedTuple):
    data: np.ndarray  # the text's bytes
    start: np.ndarray
    end: np.ndarray
    roll: Rolling


def scan(data: bytes) -> Words:
    """Words are runs of bytes other than the six ASCII blanks."""
    b = np.frombuffer(data, dtype=np.uint8)
    space = _SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    return Words(b, edge[::2], edge[1::2], Rolling(b.astype(np.uint64) + np.uint64(1)))
