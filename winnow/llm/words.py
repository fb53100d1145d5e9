"""Words of many texts at once: places, ends and 64-bit hashes, in numpy.

A word is a run of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z became a-z: digits, ASCII
letters and everything beyond ASCII. In UTF-8 that is a test on single bytes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

U64 = np.uint64
_BYTES = np.arange(256, dtype=np.uint8)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
LOWER = np.where(_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)
IS_WORD = (
    ((_BYTES >= 48) & (_BYTES <= 57)) | _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
)
#: Bytes whose running sums are held at a time. One longer word is a block of its own.
BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=U64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=U64)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64: spreads every bit over all bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_VALUE_LOWER = _VALUE[LOWER]


def running(buffer: np.ndarray, values: np.ndarray = _VALUE) -> np.ndarray:
    """Running sums of byte values times powers; any stretch's hash follows from two of them."""
    sums = np.zeros(len(buffer) + 1, dtype=U64)
    np.cumsum(values[buffer] * powers(_BASE, len(buffer)), dtype=U64, out=sums[1:])
    return sums


def stretch_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(_INVERSE, len(sums))[starts])


class Words(NamedTuple):
    """All words of some texts, in order. `first[d]` is the first word of text d."""

    buffer: np.ndarray  # the texts' bytes, a zero byte after each
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def text_of(self) -> np.ndarray:
        """The number of the text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(texts: list[bytes]) -> Words:
    buffer = np.frombuffer(b"\0".join([*texts, b""]), dtype=np.uint8)
    inside = np.zeros(len(buffer) + 2, dtype=np.int8)
    inside[1:-1] = IS_WORD[buffer]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(start, begin)
    hashes = np.zeros(len(start), U64)
    a = 0
    while a < len(start):  # some bytes at a time: running sums take eight bytes for each
        b = max(int(np.searchsorted(end, start[a] + BLOCK_BYTES, "right")), a + 1)
        sums = running(buffer[start[a] : end[b - 1]], _VALUE_LOWER)
        hashes[a:b] = stretch_hash(sums, start[a:b] - start[a], end[a:b] - start[a])
        a = b
    return Words(buffer, start, end, first, hashes)


def plain_words(text: str | None) -> list[str]:
    """The same words of one text, as strings."""
    import re

    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
