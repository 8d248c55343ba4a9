"""Numpy kernels over flat byte buffers: words, rolling hashes and winnowed anchors.

Hashes are polynomials modulo 2^64 with odd bases, read off prefix sums and mixed. They depend on content only, so
any task computes the same value for the same words or bytes.
"""

from __future__ import annotations

import numpy as np

#: ASCII blanks, the only bytes that end a word.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xD6E8FEB86659FD93)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k modulo 2^64 for k from 0 to n at least."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) <= n:
        size = 1 << max(12, int(n).bit_length())
        steps = np.full(size, base, np.uint64)
        back = np.full(size, np.uint64(_inverse(int(base))), np.uint64)
        steps[0] = back[0] = 1
        have = np.multiply.accumulate(steps), np.multiply.accumulate(back)
        _powers[int(base)] = have
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any run of a sequence of values, from one pass of prefix sums."""

    def __init__(self, values: np.ndarray, base: np.uint64):
        up, self.down = powers(base, len(values))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values.astype(np.uint64) * up[: len(values)], out=self.sums[1:])

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def every(self, length: int) -> np.ndarray:
        """The hash of each run of `length` values, by start."""
        n = max(0, len(self.sums) - length)
        return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n]) if n else np.zeros(0, np.uint64)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of several texts, and the number of words up to each text's end."""
    inside = ~BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    hashes = Rolling(data + np.uint64(1), BYTE_BASE).runs(starts, ends)
    return mixed(hashes + (ends - starts).astype(np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours, by start."""
    if len(x) < width:
        return x[:0]
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` grams the place of its least gram, the leftmost of equals.

    The low bits of a gram's hash give way to its place, so one running minimum yields places; which gram is chosen
    depends on the window's content alone.
    """
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    key = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    return (sliding_min(key, width) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def within(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted set."""
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_set, values)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == values
