"""A run-length grammar of a sequence by recompression, and extension queries on it, in numpy.

Rounds alternate until little is left. Block compression replaces every stretch of one symbol by a
symbol for (symbol, length); pair compression deals the symbols into left and right ones by a
seeded bit and replaces every left symbol that a right one follows, with it, by a symbol for the
pair. Equal symbols of a round stand for equal stretches, and away from their ends equal stretches
are replaced alike, so a query climbs while both sides start a symbol together, runs along equal
symbols a block at a time, and comes down where they differ: some steps per round.

Rounds shrink by a quarter on average, so all of them hold a few symbols for one of the sequence.
"""

from __future__ import annotations

import numpy as np

from winnow.llm.words import mix

#: Sequences from this length on need 64-bit numbers.
LONG = 100_000_000


def _named(keys: np.ndarray, least: int) -> tuple[np.ndarray, int]:
    """Numbers from `least` on, equal for equal keys; and the next free number."""
    order = np.argsort(keys)
    ordered = keys[order]
    fresh = np.empty(len(keys), bool)
    fresh[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:])
    rank = np.cumsum(fresh)
    names = np.empty(len(keys), np.int64)
    names[order] = rank + (least - 1)
    return names, least + (int(rank[-1]) if len(rank) else 0)


class Grammar:
    """All rounds one behind the other: symbol number g of a round has its place in `symbol`, the
    words it covers in `size`, the first and last of its parts in `low` and `high` (a round below)
    and the symbol it becomes part of in `above`. `ahead` and `behind` count equal symbols from a
    place on and up to it. The sequence must begin and end with symbols found nowhere else."""

    def __init__(self, sequence: np.ndarray, enough: int = 16, seed: int = 1):
        self.kind = np.int32 if len(sequence) < LONG else np.int64
        symbol = sequence.astype(np.int64)
        free = int(symbol.max(initial=0)) + 1
        size = np.ones(len(symbol), self.kind)
        rounds, sizes, heads, blocks = [symbol], [size], [], []
        turn = 0
        while len(symbol) > enough:
            same = symbol[1:] == symbol[:-1]
            if same.any():
                head = np.flatnonzero(np.concatenate([[True], ~same]))
                count = np.diff(np.append(head, len(symbol)))
                blocks.append((head, count))
                shorter = symbol[head]
                long = count > 1
                names, free = _named(shorter[long] << 32 | count[long], free)
            else:
                blocks.append(None)
                turn += 1
                salt = np.uint64((seed + turn) * 0x9E3779B97F4A7C15 % (1 << 64))
                is_left = mix(symbol.astype(np.uint64) + salt)
                is_left = (is_left >> np.uint64(63)).astype(bool)
                pair = np.concatenate([is_left[:-1] & ~is_left[1:], [False]])
                head = np.flatnonzero(np.concatenate([[True], ~pair[:-1]]))
                shorter = symbol[head]
                long = pair[head]
                names, free = _named(shorter[long] << 32 | symbol[head[long] + 1], free)
            if len(head) == len(symbol):
                blocks.pop()
                continue
            shorter[long] = names
            size = np.add.reduceat(size, head).astype(self.kind)
            symbol = shorter
            rounds.append(symbol)
            sizes.append(size)
            heads.append(head)
        blocks.append(None)
        self._join(rounds, sizes, heads, blocks)

    def _join(self, rounds: list, sizes: list, heads: list, blocks: list) -> None:
        start = np.cumsum([0, *(len(r) for r in rounds)])
        total = int(start[-1])
        self.symbol, self.size = np.concatenate(rounds), np.concatenate(sizes)
        if total < LONG:
            self.symbol = self.symbol.astype(np.int32)
        self.low, self.high = np.zeros(total, self.kind), np.zeros(total, self.kind)
        self.above = np.full(total, -1, self.kind)
        self.ahead, self.behind = np.ones(total, self.kind), np.ones(total, self.kind)
        for i, head in enumerate(heads):
            here, there = slice(start[i], start[i + 1]), slice(start[i + 1], start[i + 2])
            last = np.append(head[1:], len(rounds[i])) - 1
            self.low[there], self.high[there] = head + start[i], last + start[i]
            self.above[here] = np.repeat(np.arange(start[i + 1], start[i + 2]), last - head + 1)
        for i, block in enumerate(blocks):
            if block is not None:
                head, count = block
                place = np.arange(len(rounds[i])) - np.repeat(head, count)
                self.behind[start[i] : start[i + 1]] = place + 1
                self.ahead[start[i] : start[i + 1]] = np.repeat(count, count) - place
        self.base, self.top = int(start[1]), len(rounds) - 1

    def common(self, x: np.ndarray, y: np.ndarray, ahead: bool) -> np.ndarray:
        """How many words are equal from places x and y on (both included), or up to them."""
        edge, stretch, step = (self.low, self.ahead, 1) if ahead else (self.high, self.behind, -1)
        found = np.zeros(len(x), np.int64)
        who = np.flatnonzero(self.symbol[x] == self.symbol[y])
        x, y = x[who].astype(self.kind), y[who].astype(self.kind)
        level, most = np.zeros(len(who), np.int16), np.full(len(who), self.top, np.int16)
        while len(who):
            equal = self.symbol[x] == self.symbol[y]
            up = equal & (level < most)
            px, py = self.above[x], self.above[y]
            up &= (edge[px] == x) & (edge[py] == y)
            differ = up & (self.symbol[px] != self.symbol[py])
            np.minimum(most, level, out=most, where=differ)  # the first difference is below px, py
            up &= ~differ
            along = equal & ~up
            many = np.where(along, np.minimum(stretch[x], stretch[y]), 0)
            found[who] += many.astype(np.int64) * self.size[x]
            x, y, level = np.where(up, px, x + step * many), np.where(up, py, y + step * many), level + up
            down = ~equal & (level > 0)
            x, y = np.where(down, edge[x], x), np.where(down, edge[y], y)
            level = level - down
            np.minimum(most, level, out=most, where=down)
            on = equal | down
            if not on.all():
                who, x, y, level, most = who[on], x[on], y[on], level[on], most[on]
        return found
