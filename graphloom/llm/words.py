"""Words of a text as byte spans, with 64-bit hashes of words and of runs of words, all in numpy."""

from __future__ import annotations

import numpy as np

from .common import mix64

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB4F)


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate((self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))))
            self.down = np.concatenate((self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))))
        return self.up[:n], self.down[:n]


class Hasher:
    """Hashes of words and of windows of words; holds the powers that it has used, up to the longest text."""

    def __init__(self):
        self.byte, self.word = (Powers(b) for b in _BASES)

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words of UTF-8 data in bytes, and a hash of each."""
        buf = np.frombuffer(data, np.uint8)
        edge = np.flatnonzero(np.diff(_SPACE[buf], prepend=True, append=True))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            return starts, ends, np.zeros(0, np.uint64)
        up, down = self.byte.get(len(buf) + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[buf] * up[:-1], dtype=np.uint64)))
        return starts, ends, mix64((total[ends] - total[starts]) * down[starts])

    def windows(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """A hash of each run of size words."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        up, down = self.word.get(len(hashes) + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[:-1], dtype=np.uint64)))
        return mix64((total[size:] - total[:n]) * down[:n])


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n positions lie in a run of size positions from one of starts."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + size, n), -1)
    return np.cumsum(marks[:n]) > 0


def repeated(values: np.ndarray) -> np.ndarray:
    """Positions of the values found twice or more."""
    if len(values) < 2:
        return np.zeros(0, np.int64)
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    same = ordered[1:] == ordered[:-1]
    return order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
