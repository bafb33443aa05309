"""A compressed FM-index over integer symbols: suffix order, wavelet levels as packed bits, backward search."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Start positions in order of their first `depth` symbols at least (prefix doubling)."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, size = len(text), 1
    order = np.argsort(rank, kind="stable")
    while size < depth:
        after = np.full(n, 0, np.int64)
        after[: max(0, n - size)] = rank[size:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        step = np.diff(key[order]) != 0
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(step)))
        if step.all():
            break
        size *= 2
    return order


class FMIndex:
    """Symbols are 0..sigma-1; every array holds about log2(sigma) bits a symbol plus one count per 64 bits."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        order = suffix_order(text, depth)
        self.size, self.levels = n, max(1, int(text.max()).bit_length())
        sigma = 1 << self.levels
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        seq = text[order - 1]  # position -1 is the last symbol
        self.bits, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate((packed, np.zeros(-len(packed) % 8 + 8, np.uint8))).view(np.uint64)
            self.bits.append(packed)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed).astype(np.int64)))).astype(np.int32))
            self.zeros.append(int(n - bit.sum()))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))
        every = np.arange(sigma)
        self.shift = self.before[:-1] - self._walk(every, np.zeros(sigma, np.int64))

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[k][word] + np.bitwise_count(self.bits[k][word] & below).astype(np.int64)

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            ones = self._ones(k, at)
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: intervals of the patterns with `symbol` put in front."""
        return self.shift[symbol] + self._walk(symbol, lo), self.shift[symbol] + self._walk(symbol, hi)

    def repeated(self, text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Which patterns text[s : s + length] occur at least twice (numbers into starts), and their interval's start.

        The matching statistic of a position is followed only while its interval holds two suffixes; those
        that fall below the threshold length are dropped on the way.
        """
        live = np.arange(len(starts))
        first = text[starts + length - 1]
        lo, hi = self.before[first], self.before[first + 1]
        for back in range(length - 2, -1, -1):
            keep = hi - lo > 1
            live, lo, hi = live[keep], lo[keep], hi[keep]
            if not len(live):
                break
            lo, hi = self.extend(text[starts[live] + back], lo, hi)
        keep = hi - lo > 1
        return live[keep], lo[keep]
