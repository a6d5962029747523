"""FM-index of an integer sequence: suffix array by doubling, wavelet matrix of its BWT, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of all suffixes; the sequence's last value must be its only least one."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(np.diff(key[order]) > 0)))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """Ranks of symbols by one bit vector a level, most significant bit first."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        seq = seq.astype(np.int64)
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(len(seq) - int(self.ones[-1][-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, high = np.zeros(len(at), np.int64), at.astype(np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbol >> (self.bits - 1 - k)) & 1
            low1, high1 = ones[low], ones[high]
            low = np.where(bit, zeros + low1, low - low1)
            high = np.where(bit, zeros + high1, high - high1)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(at), np.int64), at.astype(np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[at + 1] - ones[at]
            out = out * 2 + bit
            at = np.where(bit, zeros + ones[at], at - ones[at])
        return out


class FMIndex:
    """Search of many patterns at once. Symbols are 1 and up; 0 ends the sequence and is added here."""

    def __init__(self, seq: np.ndarray, symbols: int, every: int = 8):
        seq = np.append(seq, 0)
        order = suffix_array(seq)
        self.n = len(seq)
        self.bwt = WaveletMatrix(seq[order - 1], symbols)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=symbols))))
        sampled = order % every == 0
        self.sample_rank = np.concatenate(([0], np.cumsum(sampled))).astype(np.int64)
        self.samples = order[sampled]

    def ranges(self, patterns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of the patterns; steps backwards through all that are still found."""
        lengths = np.array([len(p) for p in patterns], np.int64)
        low, high = np.zeros(len(patterns), np.int64), np.where(lengths > 0, self.n, 0)
        ends, flat = np.cumsum(lengths), np.concatenate(patterns) if patterns else np.zeros(0, np.int64)
        alive = np.flatnonzero(high > low)
        step = 1
        while len(alive := alive[lengths[alive] >= step]):
            symbol = flat[ends[alive] - step]
            low[alive] = self.first[symbol] + self.bwt.rank(symbol, low[alive])
            high[alive] = self.first[symbol] + self.bwt.rank(symbol, high[alive])
            alive = alive[high[alive] > low[alive]]
            step += 1
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks, by steps back to a sampled one."""
        rows, steps, out = rows.astype(np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            hit = self.sample_rank[at + 1] > self.sample_rank[at]
            done = open_[hit]
            out[done] = self.samples[self.sample_rank[rows[done]]] + steps[done]
            open_ = open_[~hit]
            at = rows[open_]
            symbol = self.bwt.access(at)
            rows[open_] = self.first[symbol] + self.bwt.rank(symbol, at)
            steps[open_] += 1
        return out
