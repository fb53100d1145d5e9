"""An FM-index over whole numbers: suffix order, wavelet matrix, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_order(tokens: np.ndarray) -> np.ndarray:
    """Suffixes in order. Each 0 is a separator, lower than all else and different from other zeros."""
    n = len(tokens)
    gaps = tokens == 0
    rank = tokens.astype(np.int64) + int(gaps.sum())
    rank[gaps] = np.arange(int(gaps.sum()))
    order = np.argsort(rank, kind="stable")
    step = 1
    ordered = rank[order]
    rank = np.empty(n, np.int64)
    # A rank is the place of the first member of its group, so groups can be refined apart.
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while True:
        ends = np.r_[np.flatnonzero(new), n]
        tied = np.repeat(np.diff(ends) > 1, np.diff(ends))
        places = np.flatnonzero(tied)
        if not len(places):
            return order
        at = order[places]
        own, later = rank[at], rank[np.minimum(at + step, n - 1)]
        by = np.lexsort((later, own))
        order[places] = at = at[by]
        own, later = own[by], later[by]
        new[places] = np.r_[True, (own[1:] != own[:-1]) | (later[1:] != later[:-1])]
        rank[at] = np.maximum.accumulate(np.where(new[places], places, 0))
        step *= 2


class FMIndex:
    """Counts and finds phrases. `tokens` must begin and end with the separator 0."""

    def __init__(self, tokens: np.ndarray, sample: int = 8):
        n = len(tokens)
        order = suffix_order(tokens)
        last = tokens[order - 1]
        self.levels, self.zeros = [], []
        self.sigma = int(tokens.max(initial=0)) + 1
        self.depth = max(1, (self.sigma - 1).bit_length())
        column = last
        for level in reversed(range(self.depth)):
            ones = (column >> level & 1).astype(bool)
            self.levels.append(np.r_[0, np.cumsum(ones, dtype=np.int32)])
            self.zeros.append(int(n - ones.sum()))
            column = np.r_[column[~ones], column[ones]]
        counts = np.bincount(tokens, minlength=self.sigma)
        self.before = np.r_[0, np.cumsum(counts)]  # rows that begin with a smaller token
        # Sampled: every `sample`-th position, and each that follows a separator.
        kept = order % sample == 0
        kept |= last == 0
        self.marks = np.r_[0, np.cumsum(kept, dtype=np.int32)]
        self.kept, self.position = kept, order[kept]
        self.last = last

    def _rank(self, token: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often a token comes among the first `row` last tokens."""
        begin = np.zeros(len(row), np.int64)
        for k, level in enumerate(reversed(range(self.depth))):
            ones, bit = self.levels[k], (token >> level & 1).astype(bool)
            up_to, from_ = ones[row], ones[begin]
            row = np.where(bit, self.zeros[k] + up_to, row - up_to)
            begin = np.where(bit, self.zeros[k] + from_, begin - from_)
        return row - begin

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of phrases (rows of a matrix, filled up on the right)."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.before[-1], np.int64)
        done = np.zeros(len(phrases), np.int64)
        while True:
            live = np.flatnonzero((done < lengths) & (low < high))
            if not len(live):
                return low, np.maximum(low, high)
            token = phrases[live, lengths[live] - 1 - done[live]]
            known = token < self.sigma
            high[live[~known]] = low[live[~known]]
            live, token = live[known], token[known]
            low[live] = self.before[token] + self._rank(token, low[live])
            high[live] = self.before[token] + self._rank(token, high[live])
            done[live] += 1

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows: steps back through the text until a sampled position."""
        rows = rows.copy()
        steps = np.zeros(len(rows), np.int64)
        while True:
            live = np.flatnonzero(~self.kept[rows])
            if not len(live):
                return self.position[self.marks[rows]] + steps
            token = self.last[rows[live]].astype(np.int64)
            rows[live] = self.before[token] + self._rank(token, rows[live])
            steps[live] += 1
