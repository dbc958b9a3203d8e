"""A compressed FM-index over segments of words, searched for many segments at once."""

from __future__ import annotations

import numpy as np


class _Bits:
    """A packed bit vector with constant-time rank: one count per 64 bits."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words)[:-1], out=self.before[1:])
        self.zeros = len(bits) - int(bits.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)


class WaveletTree:
    """A balanced wavelet tree, stored level by level; rank of any symbol before any place."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels: list[tuple[int, _Bits]] = []
        for bit in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit) & 1
            self.levels.append((bit, _Bits(ones.astype(np.uint8))))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])
        every = np.arange(n_symbols)
        self.begin = self._descend(every, np.zeros(n_symbols, dtype=np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, bits in self.levels:
            ones = bits.rank(at)
            at = np.where((symbols >> bit) & 1, bits.zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbols[i] before place at[i]."""
        return self._descend(symbols, at) - self.begin[symbols]


def _ranked(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pairs (high, low), and the rank of each pair."""
    keys = high * (int(low.max(initial=0)) + 1) + low
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    rank = np.empty(len(keys), dtype=np.int64)
    rank[order] = np.cumsum(np.append(0, sorted_keys[1:] != sorted_keys[:-1]))
    return order, rank


def _shifted(values: np.ndarray, by: int) -> np.ndarray:
    """values[i + by], and 0 past the end; ranks are moved up to leave 0 free."""
    out = np.zeros(len(values), dtype=np.int64)
    if by < len(values):
        out[: len(values) - by] = values[by:] + 1
    return out


class FmIndex:
    """Segments of words with a number (a document id) for each segment.

    Suffixes are sorted by their first `width` words, which is all that searches of up to
    `width` words need. Symbol 0 ends every segment.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, owners: np.ndarray, width: int):
        self.width = width
        self.alphabet, dense = np.unique(words, return_inverse=True)
        n_segments = len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(len(words) + n_segments, dtype=np.int64)
        inside = np.ones(len(text), dtype=bool)
        inside[ends] = False
        text[inside] = dense + 1
        owner = np.repeat(owners, lengths + 1)
        rank, reach = text.copy(), 1
        while reach * 2 <= width:
            _, rank = _ranked(rank, _shifted(rank, reach))
            reach *= 2
        # Two overlapping runs of `reach` words make up any length up to twice of it.
        places, full = _ranked(rank, _shifted(rank, width - reach))
        _, short = _ranked(rank, _shifted(rank, width - 1 - reach)) if width > 1 else (None, np.zeros_like(rank))
        self.tree = WaveletTree(text[places - 1], len(self.alphabet) + 1)
        self.smaller = np.searchsorted(text[places], np.arange(len(self.alphabet) + 2))
        full, short = full[places], short[places]
        starts = np.flatnonzero(np.append(True, full[1:] != full[:-1]))
        least = np.minimum.reduceat(owner[places], starts)
        self.least = np.repeat(least, np.diff(np.append(starts, len(full))))
        # Interval of the suffixes that share the first width - 1 words.
        begins = np.flatnonzero(np.append(True, short[1:] != short[:-1]))
        sizes = np.diff(np.append(begins, len(short)))
        self.low, self.high = np.repeat(begins, sizes), np.repeat(begins + sizes, sizes)

    def stream(self, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Matching statistics by backward search, all segments in step from their last
        word to their first: for each word, the smallest owner of an occurrence of the
        `width` words that start there, or -1 where fewer are left in the segment.

        The segments' words must occur in the index in this order (as parts of it do), so
        that a match never has to be given up, only shortened to `width` words.
        """
        found = np.full(len(words), -1, dtype=np.int64)
        symbols = np.searchsorted(self.alphabet, words) + 1
        order = np.argsort(-lengths, kind="stable")
        last = (np.cumsum(lengths) - 1)[order]
        lengths = lengths[order]
        low = np.zeros(len(lengths), dtype=np.int64)
        high = np.full(len(lengths), self.smaller[-1], dtype=np.int64)
        for step in range(int(lengths.max(initial=0))):
            active = int(np.searchsorted(-lengths, -step, side="left"))
            low, high, at = low[:active], high[:active], last[:active] - step
            if step >= self.width:
                low, high = self.low[low], self.high[low]
            symbol = symbols[at]
            both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
            low, high = self.smaller[symbol] + both[:active], self.smaller[symbol] + both[active:]
            if np.any(low >= high):
                raise ValueError("a segment is not part of the index")
            if step + 1 >= self.width:
                found[at] = self.least[low]
        return found
