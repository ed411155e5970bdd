"""A compressed FM-index over words in numpy: one shard's index and its vectorised backward search.

The text is the shard's word sequences, dense symbols with a sentinel between them. Suffixes are ordered by their
first 16 symbols (prefix doubling), enough for patterns of up to 15; the Burrows-Wheeler transform is kept as a wavelet
matrix of bit vectors, packed 64 to a word, with a 16-bit count for each word and a 64-bit one for each 1024 words.
"""

from __future__ import annotations

import numpy as np

DEPTH = 16


class BitVector:
    def __init__(self, bits: np.ndarray):
        n = -(-(len(bits) + 1) // 64) * 64
        padded = np.zeros(n, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=before[1:])
        self.large = before[::1024].copy()
        self.small = (before - np.repeat(self.large, 1024)[: len(before)]).astype(np.uint16)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        at = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.large[at >> 10] + self.small[at] + np.bitwise_count(self.words[at] & low)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.vectors: list[BitVector] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            self.vectors.append(BitVector(bit))
            self.zeros.append(int((~bit).sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        every = np.arange(size)
        self.start = self._down(every, np.zeros(size, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (vector, zeros) in enumerate(zip(self.vectors, self.zeros, strict=True)):
            ones = vector.rank(i)
            i = np.where(symbol >> self.levels - 1 - k & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs among the first i."""
        return self._down(symbol, i) - self.start[symbol]


class FmIndex:
    """Index of sequences (codes one after another, their lengths), each with an owner (an integer)."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, owners: np.ndarray):
        self.alphabet, dense = np.unique(codes, return_inverse=True)
        n = len(codes) + len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = dense + 1
        self.text, self.begin = text.astype(np.int32), np.concatenate([[0], ends[:-1] + 1])
        rank, k = text, 1
        while k < DEPTH:
            after = np.zeros(n, np.int64)
            after[:-k] = rank[k:] if k < n else 0
            _, rank = np.unique(rank * (n + 1) + after, return_inverse=True)
            k *= 2
        order = np.argsort(rank, kind="stable")
        self.owners, rank = np.unique(owners, return_inverse=True)  # in order, so that the smallest rank is the smallest owner
        self.owner = np.append(np.repeat(rank, lengths + 1)[order], len(self.owners)).astype(np.int32)
        size = len(self.alphabet) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.bwt = WaveletMatrix(text[order - 1], size)

    def matching(self, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search from each place of the text: matching statistics against other owners, at most `most`.

        (length, low, high): how many symbols up to and with the one at `ends` occur for several owners or places, and
        the suffix range of the last range searched. A range of one row is the pattern itself, and ends the search.
        """
        symbol = self.text[ends]
        low, high = self.first[symbol], self.first[symbol + 1]
        length = np.ones(len(ends), np.int64)
        live = np.flatnonzero(high - low > 1)
        length[high - low <= 1] = 0
        for step in range(1, most):
            symbol = self.text[ends[live] - step]
            a = self.first[symbol] + self.bwt.rank(symbol, low[live])
            b = self.first[symbol] + self.bwt.rank(symbol, high[live])
            on = (b - a > 1) & (symbol > 0)
            live, a, b = live[on], a[on], b[on]
            low[live], high[live] = a, b
            length[live] += 1
        return length, low, high

    def smallest_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest owner among the suffixes of each range."""
        at, back = np.unique(low, return_inverse=True)
        top = np.zeros(len(at), np.int64)
        top[back] = high
        pairs = np.empty(2 * len(at), np.int64)
        pairs[::2], pairs[1::2] = at, top
        return self.owners[np.minimum.reduceat(self.owner, pairs)[::2]][back] if len(at) else np.zeros(0, np.int64)
