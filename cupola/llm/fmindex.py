"""An FM-index over a sequence of small integers, with all queries answered in batches."""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of s in the order of their suffixes (a suffix that ends is smaller), by prefix doubling.

    Only suffixes that still share their rank are sorted again, so long repeats cost a few rounds over
    themselves and nothing elsewhere.
    """
    n = len(s)
    sa = np.argsort(s, kind="stable")
    firsts = np.flatnonzero(np.concatenate(([True], s[sa[1:]] != s[sa[:-1]]))) if n else np.zeros(0, np.int64)
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(firsts, np.diff(np.append(firsts, n)))
    slots = np.flatnonzero(np.repeat(np.diff(np.append(firsts, n)) > 1, np.diff(np.append(firsts, n))))
    k = 1
    while len(slots):
        at = sa[slots]
        nxt = np.where(at + k < n, rank[np.minimum(at + k, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + nxt
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[slots] = at
        new = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        rank[at] = np.repeat(slots[first], size)
        slots = slots[np.repeat(size > 1, size)]
        k *= 2
    return sa


class Bits:
    """A bit vector with rank, packed into words with a running count."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(self.n // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class Wavelet:
    """A wavelet tree, its levels laid out as a matrix: at each level the zeros come before the ones, in order."""

    def __init__(self, s: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels, self.zeros = [], []
        s = s.astype(np.int64)
        for d in range(self.depth - 1, -1, -1):
            one = (s >> d) & 1 == 1
            self.levels.append(Bits(one))
            self.zeros.append(int((~one).sum()))
            s = np.concatenate((s[~one], s[one]))

    def down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i stands at the bottom among the symbols of c's node."""
        for d, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = bits.rank(i)
            i = np.where((c >> (self.depth - 1 - d)) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before position i."""
        return self.down(c, i) - self.down(c, np.zeros_like(i))

    def get(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros(len(i), np.int64)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one, ones = bits.get(i), bits.rank(i)
            c = 2 * c + one
            i = np.where(one, zeros + ones, i - ones)
        return c


class FMIndex:
    """Backward search and location of many patterns at once. s: symbols from 0 to sigma - 1."""

    def __init__(self, s: np.ndarray, sigma: int, sampled: int = 8):
        s = np.append(np.asarray(s, np.int64) + 1, 0)  # 0 ends the text
        sa = suffix_array(s)
        self.n, self.sampled = len(s), sampled
        self.tree = Wavelet(s[sa - 1], sigma + 1)
        self.below = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=sigma + 1))))
        kept = sa % sampled == 0
        self.kept, self.samples = Bits(kept), sa[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of rows [lo, hi) that begin with each pattern (its first `lengths` symbols of a row)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= back) & (lo < hi))
            if not len(live):
                break
            c = patterns[live, lengths[live] - back].astype(np.int64) + 1
            base = self.below[c] - self.tree.down(c, np.zeros_like(c))
            lo[live], hi[live] = base + self.tree.down(c, lo[live]), base + self.tree.down(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: back through the text to a sampled suffix."""
        rows = rows.astype(np.int64)
        out, todo, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(todo):
            hit = self.kept.get(rows)
            out[todo[hit]] = self.samples[self.kept.rank(rows[hit])] + steps
            todo, rows = todo[~hit], rows[~hit]
            c = self.tree.get(rows)
            rows = self.below[c] + self.tree.rank(c, rows)
            steps += 1
        return out
