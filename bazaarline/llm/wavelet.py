"""A wavelet tree in matrix form: how often a value stands in any range, level by level.

Level ``l`` has bit ``levels - 1 - l`` of each value. Values whose bit is 0 go on
to the front of the next level, the others behind them, both in their order; so a
range of positions becomes one range for each value of the bit, and elements keep
their order within it. All methods take arrays.
"""

from __future__ import annotations

import numpy as np


class Wavelet:
    """``zeros[l]`` values have bit 0 on level ``l``; bits are words of 64 with running counts."""

    def __init__(self, packed: bytes, levels: int, size: int):
        self.levels, self.size = levels, size
        self._words = np.frombuffer(packed, np.uint64).reshape(levels, -1) if levels else np.zeros((0, size // 64 + 1), np.uint64)
        ones = np.cumsum(np.bitwise_count(self._words), axis=1, dtype=np.int64)
        self._before = np.zeros((levels, self._words.shape[1]), np.int32)
        self._before[:, 1:] = ones[:, :-1]
        self.zeros = size - (ones[:, -1] if levels else np.zeros(0, np.int64))

    @staticmethod
    def pack(values: np.ndarray, levels: int) -> bytes:
        """The bits of all levels, for the constructor. A level has room for one position more than values."""
        out = np.zeros((levels, (len(values) // 64 + 1) * 8), np.uint8)
        for level in range(levels):
            ones = (values >> (levels - 1 - level)) & 1 == 1
            bits = np.packbits(ones, bitorder="little")
            out[level, : len(bits)] = bits
            values = np.concatenate([values[~ones], values[ones]])
        return out.tobytes()

    def bit(self, level, at: np.ndarray) -> np.ndarray:
        return (self._words[level, at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)

    def ones(self, level, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` positions of a level have bit 1."""
        word, below = at >> 6, (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self._before[level, word] + np.bitwise_count(self._words[level, word] & below).astype(np.int64)

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` values are ``value``."""
        low = np.zeros_like(at)
        for level in range(self.levels):
            one = (value >> (self.levels - 1 - level)) & 1 == 1
            low1, at1 = self.ones(level, low), self.ones(level, at)
            low = np.where(one, self.zeros[level] + low1, low - low1)
            at = np.where(one, self.zeros[level] + at1, at - at1)
        return at - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value at each position, and how many of the values before it are the same."""
        value, low = np.zeros_like(at), np.zeros_like(at)
        for level in range(self.levels):
            one = self.bit(level, at) == 1
            low1, at1 = self.ones(level, low), self.ones(level, at)
            low = np.where(one, self.zeros[level] + low1, low - low1)
            at = np.where(one, self.zeros[level] + at1, at - at1)
            value = value * 2 + one
        return value, at - low

    def carried(self, along: np.ndarray) -> np.ndarray:
        """``along``, one value for each position, in the order of each level: one row more than there are levels."""
        out = np.empty((self.levels + 1, self.size), along.dtype)
        out[0] = along
        for level in range(self.levels):
            ones = np.unpackbits(self._words[level].view(np.uint8), count=self.size, bitorder="little").view(bool)
            out[level + 1] = np.concatenate([out[level][~ones], out[level][ones]])
        return out
