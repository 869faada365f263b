"""Words of many texts as arrays: where they stand, and 64-bit hashes of them and of runs of them.

A word is a longest run of bytes other than space and 0x09 to 0x0D. The hash of a word is a polynomial in
its bytes; all hashes of a slice come from one running sum. Words are equal exactly if their bytes are,
but for hash collisions (2^-64 a pair).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_MASK = (1 << 64) - 1
_BYTE_BASE = 0x9E3779B97F4A7C55
_WORD_BASE = 0xD1342543DE82EF95

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _powers[base] = (both[0], both[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of a slice of texts. Those of text i are bounds[i] to bounds[i + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """All words of the texts; `lower` maps A-Z to a-z first."""
    if lower:
        data = _LOWER[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64))
    inside = ~_SPACE[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = _powers_of(_BYTE_BASE, n + 1)
    running = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=running[1:])
    hashes = mix((running[ends] - running[starts]) * down[starts])
    return Words(data, starts, ends, np.searchsorted(starts, offsets), hashes)


def runs(w: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `length` words (run i starts at word i), and which of them lie in one text."""
    n = len(w.hashes)
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    m = n - length + 1
    if length <= 8:
        total = np.zeros(m, np.uint64)
        for j in range(length):
            total *= np.uint64(_WORD_BASE)
            total += w.hashes[j : j + m]
    else:
        up, down = _powers_of(_WORD_BASE, n + 1)
        running = np.zeros(n + 1, np.uint64)
        np.cumsum(w.hashes * up[:n], out=running[1:])
        total = (running[length:] - running[:m]) * down[:m]
    ends = np.repeat(w.bounds[1:], w.counts)
    return mix(total), np.arange(length, n + 1) <= ends[:m]


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of all texts in text order, with repeats, and n + 1 bounds.

    A text of fewer than `size` words (but at least one) has its whole sequence as its one shingle.
    """
    hashes, whole = runs(w, size)
    counts = w.counts
    per_text = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(per_text, out=bounds[1:])
    out = np.empty(bounds[-1], np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    is_short = np.zeros(len(out), bool)
    for i in short:
        is_short[bounds[i]] = True
        total = counts[i]
        for h in w.hashes[w.bounds[i] : w.bounds[i + 1]].tolist():
            total = (int(total) * 0x2545F4914F6CDD1D + h) & _MASK
        out[bounds[i]] = total
    out[~is_short] = hashes[whole]
    if len(short):
        out[is_short] = mix(out[is_short])
    return out, bounds


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in rising order, and new bounds."""
    out, new = [], np.zeros(len(bounds), np.int64)
    for i in range(len(bounds) - 1):
        part = values[bounds[i] : bounds[i + 1]]
        if len(part) > 1:
            part = np.sort(part)
            part = part[np.concatenate(([True], part[1:] != part[:-1]))]
        out.append(part)
        new[i + 1] = new[i] + len(part)
    return np.concatenate(out) if out else values[:0], new
