"""A compressed FM-index over word numbers, searched for many texts side by side.

The Burrows-Wheeler transform of the indexed texts is kept as a wavelet matrix of packed bits with a count every 64 of
them, common prefixes and document numbers in the narrowest whole numbers with tables over blocks of them, so an index of n
words weighs some 5 bytes a word beside the bits; a backward step asks it for ranks of one word at both ends of an interval. Matching statistics go through a text
from right to left and shorten the match at its right end, by the longest common prefixes at the interval's ends, when
it cannot be made longer on the left. Only matches with a text of a smaller document number count.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """Packed bits with rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1])).astype(np.int32)
        self.zeros = int(len(bits) - bits.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block = at >> 6
        part = self.words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[block] + np.bitwise_count(part)


class WaveletMatrix:
    """Ranks of symbols in a sequence of numbers below 2 ** levels."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits = []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level & 1).astype(np.uint8)
            self.bits.append(Bits(bit))
            values = np.concatenate((values[bit == 0], values[bit == 1]))
        self.first = self._walk(np.arange(symbols), np.zeros(symbols, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits in zip(range(self.levels - 1, -1, -1), self.bits):
            ones = bits.rank(at)
            at = np.where(symbol >> level & 1, bits.zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        return self._walk(symbol, at) - self.first[symbol]


class RangeMin:
    """Least value of any range: the values in blocks of BLOCK, and tables of ranges of powers of two over the blocks' least
    values alone, which together weigh little more than the values."""

    BLOCK = 32

    def __init__(self, values: np.ndarray):
        low, high = int(values.min()), int(values.max())
        self.values = values.astype(np.int8 if -128 <= low and high < 128 else np.int16 if -(1 << 15) <= low and high < 1 << 15 else np.int32)
        starts = np.arange(0, len(values), self.BLOCK)
        self.tables = [np.minimum.reduceat(self.values, starts)]
        while (step := 1 << (len(self.tables) - 1)) * 2 <= len(starts):
            last = self.tables[-1]
            self.tables.append(np.minimum(last[:-step], last[step:]))
        self.greatest = np.iinfo(self.values.dtype).max
        self.flat = np.concatenate(self.tables)
        sizes = [len(t) for t in self.tables]
        self.starts = np.cumsum([0, *sizes])[:-1]
        self.tables = np.split(self.flat, self.starts[1:])
        self.inside = np.arange(self.BLOCK)

    def _part(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least of [lo, hi), which lies in one block; the greatest number if it is empty."""
        at = lo[:, None] + self.inside
        part = self.values[np.minimum(at, len(self.values) - 1)]
        return np.where(at < hi[:, None], part, self.greatest).min(axis=1)

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least of [lo, hi), which must not be empty."""
        first, last = -(-lo // self.BLOCK), hi // self.BLOCK
        out = self._part(lo, np.minimum(hi, first * self.BLOCK))
        wide = np.flatnonzero(last >= first)
        if len(wide):
            begin = last[wide] * self.BLOCK
            out[wide] = np.minimum(out[wide], self._part(begin, hi[wide]))
        wide = np.flatnonzero(last > first)
        if len(wide):
            k = np.frexp(last[wide] - first[wide])[1] - 1
            start = self.starts[k]
            whole = np.minimum(self.flat[start + first[wide]], self.flat[start + last[wide] - (1 << k)])
            out[wide] = np.minimum(out[wide], whole)
        return out

    def reach(self, at: np.ndarray, least: np.ndarray, right: bool) -> np.ndarray:
        """How far a range that starts (right) or ends (left) at `at` goes while all its values are >= least."""
        at = at.copy()
        go = self._step(at, least, right, np.arange(len(at)))
        if len(go):
            # at the border of a block: whole blocks, then into the one that stops
            block = at[go] // self.BLOCK
            for k in range(len(self.tables) - 1, -1, -1):
                step, n = 1 << k, len(self.tables[k])
                lo = block if right else block - step
                can = (lo >= 0) & (lo < n)
                can &= self.tables[k][np.clip(lo, 0, n - 1)] >= least[go]
                block = np.where(can, block + step if right else block - step, block)
            at[go] = np.minimum(block * self.BLOCK, len(self.values))
            self._step(at, least, right, go)
        return at

    def _step(self, at: np.ndarray, least: np.ndarray, right: bool, which: np.ndarray) -> np.ndarray:
        """Moves `at`, where `which` says, to where its block stops it or ends; which of them have come to the block's end."""
        here = at[which]
        places = here[:, None] + self.inside if right else here[:, None] - 1 - self.inside
        edge = (here // self.BLOCK + 1) * self.BLOCK if right else (here - 1) // self.BLOCK * self.BLOCK
        inside = (places < np.minimum(edge, len(self.values))[:, None]) if right else (places >= np.maximum(edge, 0)[:, None])
        good = inside & (self.values[np.clip(places, 0, len(self.values) - 1)] >= least[which][:, None])
        run = np.where(good.all(axis=1), self.BLOCK, good.argmin(axis=1))
        at[which] = here + run if right else here - run
        whole = (run == inside.sum(axis=1)) & (at[which] % self.BLOCK == 0) & ((at[which] < len(self.values)) if right else (at[which] > 0))
        return which[whole]


class FMIndex:
    """Index of texts (arrays of word numbers from 1), each of a document number; depth: longest pattern, at least."""

    def __init__(self, texts: list[np.ndarray], docs: np.ndarray, depth: int):
        zero = np.zeros(1, np.int64)
        joined = np.concatenate([x for t in texts for x in (t, zero)])
        n = len(joined)
        ranks, step = [joined], 1
        while step < depth:
            last = ranks[-1]
            pair = last * (int(last.max()) + 1) + np.concatenate((last[step:], last[:step]))
            ranks.append(np.unique(pair, return_inverse=True)[1])
            step *= 2
        order = np.argsort(ranks[-1], kind="stable")
        self.n, self.symbols = n, int(joined.max()) + 1
        self.matrix = WaveletMatrix(joined[order - 1], self.symbols)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(joined, minlength=self.symbols))))
        self.docs = RangeMin(np.repeat(docs, [len(t) + 1 for t in texts])[order].astype(np.int32))
        a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int32)
        for k in range(len(ranks) - 1, -1, -1):
            same = ranks[k][a % n] == ranks[k][b % n]
            step = same << k
            a, b, common = a + step, b + step, common + step.astype(np.int32)
        # common prefix of each row and the one before; none at either end
        self.common = RangeMin(np.concatenate(([-1], common, [-1])).astype(np.int32))

    def extend(self, words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with one more word in front."""
        both = self.matrix.rank(np.concatenate((words, words)), np.concatenate((lo, hi)))
        start = self.before[words]
        return start + both[: len(words)], start + both[len(words) :]

    def shorten(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The parent intervals and their lengths: as little as possible is cut off at the right end."""
        length = np.maximum(np.maximum(self.common.values[lo], self.common.values[hi]), 0).astype(np.int64)
        whole = length == 0
        # row x joins the interval on its left while the common prefix of rows x and x - 1 is long enough
        left = self.common.reach(lo + 1, length, right=False) - 1
        right = self.common.reach(hi, length, right=True)
        return np.where(whole, 0, left), np.where(whole, self.n, right), length

    def matching_statistics(self, texts: list[np.ndarray], docs: np.ndarray) -> list[np.ndarray]:
        """For each text, and each of its places: words of the longest match that starts there and occurs in an indexed
        text of a smaller document number."""
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(np.concatenate(([0], sizes)))[:-1]
        words, found = np.concatenate(texts), np.zeros(int(sizes.sum()), np.int32)
        at, lo, hi, length = sizes.copy(), np.zeros(len(texts), np.int64), np.full(len(texts), self.n), np.zeros(len(texts), np.int64)
        alive = np.flatnonzero(at > 0)
        while len(alive):
            place = starts[alive] + at[alive] - 1
            a, b = self.extend(words[place], lo[alive], hi[alive])
            good = b > a
            good[good] = self.docs.least(a[good], b[good]) < docs[alive[good]]
            on, no = alive[good], alive[~good]
            lo[on], hi[on] = a[good], b[good]
            length[on] += 1
            at[on] -= 1
            found[place[good]] = length[on]
            none = length[no] == 0
            at[no[none]] -= 1
            cut = no[~none]
            if len(cut):
                lo[cut], hi[cut], length[cut] = self.shorten(lo[cut], hi[cut])
            alive = alive[at[alive] > 0]
        return np.split(found, starts[1:])
