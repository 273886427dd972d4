"""FM-index over a sequence of word numbers: wavelet-matrix ranks, backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix order of a sequence in which 0 ends a suffix (ends compare by position), by doubling of tied ranks."""
    n = len(symbols)
    ends = symbols == 0
    rank = symbols.astype(np.int64) + int(ends.sum())
    rank[ends] = np.arange(int(ends.sum()))
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    first = np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]])
    group = np.maximum.accumulate(np.where(first, np.arange(n), 0))  # a group's number is where it begins
    rank[order] = group
    step = 1
    while True:
        size = np.bincount(group, minlength=n)
        tied = np.flatnonzero(size[group] > 1)  # places in the order
        if not len(tied):
            return order
        at = order[tied]
        follow = rank[at + step]  # a tied suffix never reaches the last end within step symbols
        key = np.lexsort((follow, group[tied]))
        at, own, follow = at[key], group[tied][key], follow[key]
        order[tied] = at
        first = np.concatenate([[True], (own[1:] != own[:-1]) | (follow[1:] != follow[:-1])])
        begin = np.maximum.accumulate(np.where(first, np.arange(len(tied)), 0))
        group[tied] = tied[begin]
        rank[at] = tied[begin]
        step *= 2


class WaveletMatrix:
    """Ranks of any symbol in a sequence: one bit vector with running counts for each bit of the symbols."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level) & 1
            self.ones.append(np.concatenate([np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(len(values) - int(bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        start = np.zeros(len(symbol), np.int64)
        place = place.astype(np.int64)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            up = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = ones[place], ones[start]
            place = np.where(up, zeros + a, place - a)
            start = np.where(up, zeros + b, start - b)
        return place - start


class FMIndex:
    """Index over symbols (0 ends a run and never occurs in a pattern)."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = 8):
        order = suffix_array(symbols)
        before = symbols[order - 1]  # the sequence begins and ends with 0, so wrapping round is harmless
        self.last = before
        self.tree = WaveletMatrix(before, sigma)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        kept = (order % sample == 0) | (before == 0)
        self.kept = kept
        self.kept_rank = np.cumsum(kept) - 1
        self.places = order[kept]

    def step(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self.below[symbol] + self.tree.rank(symbol, place)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range [lo, hi) of each pattern; patterns are right-aligned rows."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), len(self.last), np.int64)
        width = patterns.shape[1]
        for back in range(1, width + 1):
            live = np.flatnonzero((lengths >= back) & (lo < hi))
            if not len(live):
                continue
            symbol = patterns[live, width - back]
            lo[live], hi[live] = self.step(symbol, lo[live]), self.step(symbol, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffix-order rows: step backwards to the nearest sampled suffix."""
        rows = rows.copy()
        walked = np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.kept[rows])
        while len(open_):
            at = rows[open_]
            rows[open_] = self.step(self.last[at], at)
            walked[open_] += 1
            open_ = open_[~self.kept[rows[open_]]]
        return self.places[self.kept_rank[rows]] + walked
