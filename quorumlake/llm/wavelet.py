"""A wavelet matrix over small symbols in numpy: ranks and selects for many places at once."""

from __future__ import annotations

import numpy as np

_BLOCK = 64


class _Plane:
    """A row of bits as 64-bit words, with the ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // _BLOCK + 1) * _BLOCK, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, place: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)


class WaveletMatrix:
    """Symbols below 2**depth; level by level the zeros of a bit go before its ones."""

    def __init__(self, symbols: np.ndarray, depth: int) -> None:
        self.size, self.depth = len(symbols), depth
        self.planes: list[_Plane] = []
        row = symbols
        for level in range(depth - 1, -1, -1):
            bits = (row >> level) & 1
            self.planes.append(_Plane(bits))
            row = np.concatenate([row[bits == 0], row[bits == 1]])

    def below(self, symbol: int, place: np.ndarray) -> np.ndarray:
        """How many of the symbols before each place are smaller than symbol."""
        place = np.asarray(place, np.int64)
        if symbol >= 1 << self.depth:
            return place.copy()
        start, end, found = np.zeros_like(place), place, np.zeros_like(place)
        for level, plane in zip(range(self.depth - 1, -1, -1), self.planes, strict=True):
            a, b = plane.ones(start), plane.ones(end)
            if symbol >> level & 1:
                found += (end - b) - (start - a)
                start, end = plane.zeros + a, plane.zeros + b
            else:
                start, end = start - a, end - b
        return found

    def rank(self, symbols: range, place: np.ndarray) -> np.ndarray:
        """How many of the symbols before each place lie in the range."""
        return self.below(symbols.stop, place) - self.below(symbols.start, place)

    def select(self, symbols: range, number: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least place from low to high with at least number of the symbols before it; high if there is none."""
        low, high, number = (np.array(x, np.int64) for x in (low, high, number))
        while (low < high).any():
            middle = (low + high) >> 1
            enough = self.rank(symbols, middle) >= number
            high = np.where(enough, middle, high)
            low = np.where(enough | (low >= high), low, middle + 1)
        return low
