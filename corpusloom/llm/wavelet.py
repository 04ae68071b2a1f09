"""A wavelet matrix over small numbers, with rank queries for whole arrays of places."""

from __future__ import annotations

import numpy as np


class BitRanks:
    """Ones before each place of a bit array: packed words and a running count per word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[:len(packed)] = packed
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts
        self.total = int(self.before[-1] + counts[-1])

    def ones(self, place: np.ndarray) -> np.ndarray:
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)


class WaveletMatrix:
    """``values`` below ``2 ** bits``; level by level, zeros are put before ones."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.size = bits, len(values)
        self.levels: list[BitRanks] = []
        for bit in range(bits - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            self.levels.append(BitRanks(one))
            values = np.concatenate([values[~one], values[one]])

    def rank(self, value: int, place: np.ndarray) -> np.ndarray:
        """How often ``value`` stands before each ``place`` (0 .. size)."""
        begin = np.zeros(1, np.int64)
        for level, bit in zip(self.levels, range(self.bits - 1, -1, -1), strict=True):
            if value >> bit & 1:
                zeros = self.size - level.total
                begin, place = zeros + level.ones(begin), zeros + level.ones(place)
            else:
                begin, place = begin - level.ones(begin), place - level.ones(place)
        return place - begin
