"""FM-index over sequences of numbers, searched for many patterns at once.

The Burrows-Wheeler transform of the concatenated sequences is held in a wavelet
matrix: one bit vector per bit of the symbols with counts per 64 bits.  A step of
backward search is two ranks per bit, done for all patterns with array operations.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank of symbols in a sequence, in bit vectors."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bits = (symbols >> level & 1).astype(bool)
            packed = np.zeros(len(bits) // 64 + 1, np.uint64)
            raw = np.packbits(bits, bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            counts = np.bitwise_count(packed).astype(np.int64)
            self.words.append(packed)
            self.before.append(np.cumsum(counts) - counts)
            self.zeros.append(int(len(bits) - bits.sum()))
            symbols = np.concatenate((symbols[~bits], symbols[bits]))

    def descend(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Places at the lowest level; the difference to place 0 is the number of ``symbols`` before ``places``."""
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            word = places >> 6
            low = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[k][word] + np.bitwise_count(self.words[k][word] & low)
            places = np.where(symbols >> level & 1, self.zeros[k] + ones, places - ones)
        return places


class FMIndex:
    """Index of ``sequences`` for patterns of up to ``depth`` symbols.

    Suffixes are sorted by at least ``depth`` symbols, ties by place, which is all
    that patterns of that length need.
    """

    def __init__(self, values: np.ndarray, offsets: np.ndarray, depth: int) -> None:
        count = len(offsets) - 1
        self.depth, self.offsets = depth, offsets
        self.alphabet, numbers = np.unique(values, return_inverse=True)
        # Each sequence is followed by symbol 0.
        place = np.arange(len(values)) + np.repeat(np.arange(count), np.diff(offsets))
        self.text = np.zeros(len(values) + count, np.int64)
        self.text[place] = numbers + 1
        self.starts = offsets[:-1] + np.arange(count)
        n = len(self.text)
        sigma = len(self.alphabet) + 1

        rank, done, ranks = self.text, 1, {1: self.text}
        while done < depth:
            after = np.zeros(n, np.int64)
            after[: max(0, n - done)] = rank[done:] + 1
            rank = _dense(rank * (int(after.max(initial=0)) + 1) + after)
            done *= 2
            ranks[done] = rank
        self.order = np.argsort(rank, kind="stable")
        self.size = n
        self.wavelet = WaveletMatrix(self.text[self.order - 1], sigma)
        smaller = np.concatenate(([0], np.cumsum(np.bincount(self.text, minlength=sigma))))[:-1]
        symbols = np.arange(sigma)
        self.shift = smaller - self.wavelet.descend(symbols, np.zeros(sigma, np.int64))

        # First and last row with the same depth - 1 symbols, to take one symbol off a match.
        half = max(k for k in ranks if k <= max(1, depth - 1))
        same = self._same(ranks[half], half, depth - 1)
        group = np.cumsum(~same) - 1
        first = np.flatnonzero(~same)
        self.shorter_lo = first[group]
        self.shorter_hi = np.append(first[1:], n)[group]

    def _same(self, rank: np.ndarray, known: int, length: int) -> np.ndarray:
        """Whether each row shares its first ``length`` symbols with the row above, from ranks of ``known`` symbols."""
        n = self.size
        same = np.zeros(n, bool)
        if length == 0:
            same[1:] = True
            return same
        a, b = self.order[1:], self.order[:-1]
        padded = np.concatenate((rank, np.full(length, -1)))
        same[1:] = (padded[a] == padded[b]) & (padded[a + length - known] == padded[b + length - known])
        return same

    def step(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``symbol + match`` for the rows [lo, hi) of each match."""
        both = self.wavelet.descend(np.concatenate((symbols, symbols)), np.concatenate((lo, hi)))
        shift = self.shift[symbols]
        return shift + both[: len(lo)], shift + both[len(lo) :]

    def number(self, values: np.ndarray) -> np.ndarray:
        """Symbols of raw values; values that the index lacks become -1."""
        at = np.minimum(np.searchsorted(self.alphabet, values), max(0, len(self.alphabet) - 1))
        if not len(self.alphabet):
            return np.full(len(values), -1)
        return np.where(self.alphabet[at] == values, at + 1, -1)


def _dense(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    ordered = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
    return rank


def matching_windows(index: FMIndex, values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches of ``index.depth`` symbols in streamed sequences: (place of the window, first row, end row).

    Every sequence is read from its right end.  A match that reaches the full depth
    is reported, loses its last symbol by a look-up and goes on to the left; one
    that breaks starts again one symbol further left.  All sequences advance together.
    """
    depth = index.depth
    symbols = index.number(values)
    right = offsets[1:].copy()
    floor = offsets[:-1] + depth
    active = np.flatnonzero(right >= floor)
    right, floor = right[active], floor[active]
    size = np.zeros(len(active), np.int64)
    lo, hi = np.zeros(len(active), np.int64), np.full(len(active), index.size)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(right):
        symbol = symbols[right - 1 - size]
        lo, hi = index.step(np.maximum(symbol, 0), lo, hi)
        size = size + 1
        broken = (hi <= lo) | (symbol < 0)
        full = ~broken & (size == depth)
        if full.any():
            found.append((right[full] - depth, lo[full], hi[full]))
            lo[full], hi[full] = index.shorter_lo[lo[full]], index.shorter_hi[lo[full]]
            size[full] -= 1
        lo[broken], hi[broken], size[broken] = 0, index.size, 0
        right[broken | full] -= 1
        keep = right >= floor
        if not keep.all():
            right, floor, size, lo, hi = right[keep], floor[keep], size[keep], lo[keep], hi[keep]
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(parts) for parts in zip(*found))
