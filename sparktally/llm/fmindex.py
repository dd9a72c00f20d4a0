"""FM-index over sequences of word numbers: suffix order, wavelet matrix, backward search, locate.

Symbol 0 separates runs. Every separator counts as a symbol of its own, smaller than all
words and ordered by place, so no two suffixes are equal and none reads past its run.
"""

from __future__ import annotations

import numpy as np

SAMPLING = 8


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order; prefix doubling that only re-sorts ties."""
    n = len(text)
    separator = text == 0
    first = np.where(separator, 0, text.astype(np.int64) + n)
    first[separator] = np.arange(int(separator.sum()))
    order = np.argsort(first, kind="stable")
    rank = np.empty(n, np.int64)
    place = np.arange(n)
    change = np.concatenate([[True], first[order][1:] != first[order][:-1]])
    rank[order] = np.maximum.accumulate(np.where(change, place, 0))
    step = 1
    tied = _tied(place, change)
    while len(tied):
        at = order[tied]
        key = rank[at] * (n + 1) + rank[at + step]  # a tied suffix is longer than step: its run's separator ends ties
        sort = np.argsort(key, kind="stable")
        order[tied] = at[sort]
        key = key[sort]
        change = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[tied]] = np.maximum.accumulate(np.where(change, tied, 0))
        tied = _tied(tied, change)
        step *= 2
    return order


def _tied(places: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Places whose group, which begins at a change, has more than one member."""
    last = np.concatenate([change[1:], [True]])
    return places[~(change & last)]


class FMIndex:
    """Index of ``text``, which must end with a separator; symbols are 0..top."""

    def __init__(self, text: np.ndarray, top: int):
        order = suffix_order(text)
        before = text[order - 1]
        self.n = len(text)
        self.before = before
        counts = np.bincount(text, minlength=top + 1)
        self.smaller = np.concatenate([[0], np.cumsum(counts)])  # separators come first
        self.levels = max(1, int(top).bit_length())
        self.zeros = []
        current = before
        for level in range(self.levels - 1, -1, -1):
            bit = (current >> level) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(bit == 0)]).astype(np.int32))
            current = np.concatenate([current[bit == 0], current[bit == 1]])
        # sampled positions: every SAMPLING-th and the first of each run, where walking back must stop
        sampled = (order % SAMPLING == 0) | (before == 0)
        self.sampled = sampled
        self.sample_number = np.cumsum(sampled) - 1
        self.samples = order[sampled]

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Rows reached by putting ``symbol`` before the suffixes below ``row``: ranks in the wavelet matrix."""
        at, base = row.astype(np.int64), np.zeros(len(row), np.int64)
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            zeros = self.zeros[i]
            one = ((symbol >> level) & 1).astype(bool)
            a, b = zeros[at], zeros[base]
            at = np.where(one, zeros[-1] + at - a, a)
            base = np.where(one, zeros[-1] + base - b, b)
        return self.smaller[symbol] + at - base

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of right-aligned patterns, all searched together from their last word."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        live = np.arange(len(patterns))
        for back in range(width):
            live = live[(lengths[live] > back) & (lo[live] < hi[live])]
            if not len(live):
                break
            symbol = patterns[live, width - 1 - back]
            lo[live] = self.step(symbol, lo[live])
            hi[live] = self.step(symbol, hi[live])
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled one."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.sampled[at])
        while len(live):
            here = at[live]
            at[live] = self.step(self.before[here], here)
            steps[live] += 1
            live = live[~self.sampled[at[live]]]
        return self.samples[self.sample_number[at]] + steps
