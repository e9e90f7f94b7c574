"""FM-index over integer words: suffix order, Burrows-Wheeler transform, wavelet-matrix ranks, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 8
#: Most words of one index: three positions fit in a 64-bit sort key.
MOST = (1 << 20) - 1


def suffix_array(s: np.ndarray, sigma: int) -> np.ndarray:
    """Order of the suffixes of ``s`` (words 1..sigma; 0 separates and ends it); equal up to a 0: by position.

    Prefix doubling: packed words first, then only positions whose place is still open.
    """
    n = len(s)
    at = np.arange(n, dtype=np.int64)
    ends = np.where(s == 0, at, n)
    run = np.minimum.accumulate(ends[::-1])[::-1] - at  # words before the next separator
    place, wide = 21, max(1, int(sigma).bit_length())
    h = max(1, (63 - place) // wide)
    key = np.zeros(n, np.int64)
    for j in range(h):
        key <<= wide
        live = np.flatnonzero(run > j)
        key[live] |= s[live + j]
    order = np.sort((key << place) | at)
    heads = order >> place
    sa = order & ((1 << place) - 1)
    rank = np.empty(n, np.int64)
    slots = at
    first = np.flatnonzero(np.diff(heads, prepend=heads[:1] - 1) != 0)
    while True:
        sizes = np.diff(np.append(first, len(slots)))
        here = sa[slots]
        settled = (np.repeat(sizes, sizes) == 1) | (run[here] < h)
        rank[here] = np.where(settled, slots, slots[np.repeat(first, sizes)])
        slots = slots[~settled]
        if not len(slots):
            return sa
        here = sa[slots]
        order = np.sort((rank[here] << (2 * place)) | (rank[here + h] << place) | here)
        sa[slots] = order & ((1 << place) - 1)
        heads = order >> place
        first = np.flatnonzero(np.diff(heads, prepend=heads[:1] - 1) != 0)
        h *= 2


class FmIndex:
    def __init__(self, s: np.ndarray, sigma: int):
        """s: int64 words, 0 separates; must end with 0 and have at most MOST words."""
        sa = suffix_array(s, sigma)
        before = s[sa - 1]  # of position 0: the last separator
        counts = np.bincount(s, minlength=sigma + 1)
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        self.levels = []
        x = before
        for level in range(max(1, int(sigma).bit_length()) - 1, -1, -1):
            bit = ((x >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(x) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            ahead = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            zeros = int(len(x) - bit.sum())
            self.levels.append((level, words, ahead, zeros))
            x = np.concatenate([x[~bit], x[bit]])
        symbols = np.arange(sigma + 1)
        self.shift = self.starts[:-1] - self._down(symbols, np.zeros(sigma + 1, np.int64))
        sampled = (sa % SAMPLE == 0) | (before == 0)
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.samples = sa[sampled]

    @staticmethod
    def _ones(words, ahead, i):
        k = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return ahead[k] + np.bitwise_count(words[k] & mask).astype(np.int64)

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, words, ahead, zeros in self.levels:
            ones = self._ones(words, ahead, i)
            i = np.where((c >> level) & 1, zeros + ones, i - ones)
        return i

    def _back(self, rows: np.ndarray) -> np.ndarray:
        """Rows of the suffixes one word longer."""
        i, c = rows, np.zeros(len(rows), np.int64)
        for _, words, ahead, zeros in self.levels:
            bit = ((words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            ones = self._ones(words, ahead, i)
            c = c << 1 | bit
            i = np.where(bit, zeros + ones, i - ones)
        return i + self.shift[c]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of equally long phrases (rows): which occur, and their row intervals [lo, hi)."""
        which = np.arange(len(phrases))
        c = phrases[:, -1]
        lo, hi = self.starts[c], self.starts[c + 1]
        for k in range(phrases.shape[1] - 1, -1, -1):
            if k < phrases.shape[1] - 1:
                c = phrases[which, k]
                lo, hi = self._down(c, lo) + self.shift[c], self._down(c, hi) + self.shift[c]
            live = lo < hi
            which, lo, hi = which[live], lo[live], hi[live]
            if not len(which):
                break
        return which, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to the next sampled one."""
        found, steps = np.empty(len(rows), np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            hit = self.sampled[rows]
            found[open_[hit]] = self.samples[self.sample_rank[rows[hit]]] + steps
            open_, rows = open_[~hit], rows[~hit]
            if len(open_):
                rows = self._back(rows)
                steps += 1
        return found
