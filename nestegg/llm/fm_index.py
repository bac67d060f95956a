"""FM-index over an integer sequence, searched for many phrases at once with numpy."""

from __future__ import annotations

import numpy as np

SAMPLE_RATE = 16


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order (prefix doubling; the last symbol must be unique)."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        tail = np.zeros(n, np.int64)
        tail[:-width or None] = rank[width:] + 1 if width < n else 0
        key = rank * (n + 1) + tail
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = new
        if rank[order[-1]] == n - 1 or width >= n:
            return order
        width *= 2


class WaveletRanks:
    """Wavelet matrix: for each bit, high to low, a running count of zeros at every position."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.bits = list(range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1))
        self.zeros = []
        level = symbols
        for b in self.bits:
            bit = (level >> b) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - bit)]).astype(np.int32))
            level = np.concatenate([level[bit == 0], level[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before position ``at``."""
        lo, hi = np.zeros_like(at), at
        for b, zeros in zip(self.bits, self.zeros):
            one = ((symbol >> b) & 1).astype(bool)
            z_lo, z_hi = zeros[lo], zeros[hi]
            lo = np.where(one, zeros[-1] + lo - z_lo, z_lo)
            hi = np.where(one, zeros[-1] + hi - z_hi, z_hi)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for zeros in self.zeros:
            one = zeros[at + 1] == zeros[at]
            symbol = symbol * 2 + one
            at = np.where(one, zeros[-1] + at - zeros[at], zeros[at])
        return symbol


class FMIndex:
    """``text``: symbols from 1; the index appends the end symbol 0."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        text = np.concatenate([text, [0]]).astype(np.int64)
        order = suffix_order(text)
        self.ranks = WaveletRanks(text[order - 1], n_symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        sampled = order % SAMPLE_RATE == 0
        self.is_sample = sampled
        self.sample_rank = np.concatenate([[0], np.cumsum(sampled)])
        self.samples = order[sampled]
        self.n = len(text)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of the phrases (rows of a matrix, aligned to the right), by backward search."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for step in range(phrases.shape[1]):
            live = np.flatnonzero((lengths > step) & (lo < hi))
            if not len(live):
                break
            c = phrases[live, phrases.shape[1] - 1 - step]
            lo[live] = self.first[c] + self.ranks.rank(c, lo[live])
            hi[live] = self.first[c] + self.ranks.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back to the nearest sampled suffix."""
        found, at, todo = np.zeros(len(rows), np.int64), rows.copy(), np.arange(len(rows))
        steps = 0
        while len(todo):
            here = at[todo]
            done = self.is_sample[here]
            found[todo[done]] = self.samples[self.sample_rank[here[done]]] + steps
            todo, here = todo[~done], here[~done]
            c = self.ranks.access(here)
            at[todo] = self.first[c] + self.ranks.rank(c, here)
            steps += 1
        return found
