"""A compressed full-text index over word numbers, searched for many patterns at once.

The transform of the indexed sequence lies in a wavelet matrix: one bit vector for each bit of a word's number, packed
in 64-bit words with running counts. Words are numbered by frequency in Huffman manner of whole bits: the index has as
many levels as the largest number has bits.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        part = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(part)


class FMIndex:
    """Index of the sequences ``symbols[first[i]:first[i + 1]]`` for patterns of up to ``depth`` words.

    ``symbols`` are numbers from 1. Suffixes are sorted by their first ``depth + 1`` words, which suffices
    for backward search of ``depth`` words. Sequences end with a separator, number 0, that no pattern contains.
    """

    def __init__(self, symbols: np.ndarray, first: np.ndarray, depth: int):
        count = len(first) - 1
        self.owner = np.repeat(np.arange(count), np.diff(first) + 1)
        text = np.zeros(len(symbols) + count, np.int64)
        inside = np.ones(len(text), bool)
        inside[first[1:] + np.arange(count)] = False
        text[inside] = symbols
        self.size = len(text)
        order = self._sorted_suffixes(text, depth + 1)
        self.suffix_owner = self.owner[order]
        last = text[order - 1]  # the word before each suffix
        top = int(text.max(initial=1))
        self.levels = max(1, top.bit_length())
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.bits, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bit = (last >> level & 1).astype(bool)
            self.bits.append(Bits(bit))
            self.zeros.append(int((~bit).sum()))
            last = np.concatenate([last[~bit], last[bit]])
        # where the run of each number begins on the lowest level
        self.base = self._walk(np.arange(top + 1), np.zeros(top + 1, np.int64))

    @staticmethod
    def _sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
        rank, width, n = text, 1, len(text)
        while width < depth:
            beyond = np.zeros(n, np.int64)
            beyond[: max(0, n - width)] = rank[width:] + 1
            key = rank * (n + 2) + beyond
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]])) if n else 0
            width *= 2
        return np.argsort(rank, kind="stable")

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The place on the lowest level that ``at`` leads to, following the bits of ``symbol``."""
        for i, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            ones = bits.ones(at)
            one = (symbol >> (self.levels - 1 - i) & 1).astype(bool)
            at = np.where(one, zeros + ones, at - ones)
        return at

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges of patterns with ``symbol`` put in front."""
        both = self._walk(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        shift = self.begin[symbol] - self.base[symbol]
        return both[: len(low)] + shift, both[len(low) :] + shift

    def search(self, symbols: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the patterns ``symbols[end - length:end]``, by backward search of all at once.

        A pattern whose range has shrunk to one suffix has no second place and keeps that range.
        """
        word = symbols[ends - 1]
        low, high = self.begin[word].copy(), self.begin[word + 1].copy()
        live = np.arange(len(ends))
        for step in range(2, length + 1):
            live = live[high[live] - low[live] > 1]
            if not len(live):
                break
            low[live], high[live] = self.extend(low[live], high[live], symbols[ends[live] - step])
        return low, high

    def smallest(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The smallest ``value`` (of a sequence) over the sequences in each range."""
        key, which = np.unique(low * (self.size + 1) + high, return_inverse=True)
        a, b = key // (self.size + 1), key % (self.size + 1)
        held = np.append(value[self.suffix_owner], np.iinfo(np.int64).max)
        return np.minimum.reduceat(held, np.stack([a, b], axis=1).ravel())[::2][which]
