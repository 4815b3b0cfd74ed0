"""An FM-index over sequences of word numbers: suffix order, wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np

#: Every so many places of the text, the place is kept beside its row.
SAMPLE = 16
#: Symbols of one index: three ranks are packed into one 64-bit key.
MOST = (1 << 21) - 2


class Bits:
    """A bit vector with ranks: 64 bits a word and the count of ones before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many ones are before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Ranks of symbols: a bit vector a level, highest bit first, with zeros moved before ones below it."""

    def __init__(self, values: np.ndarray, n_symbols: int):
        self.levels = []
        for shift in reversed(range(max(1, (n_symbols - 1).bit_length()))):
            one = (values >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(one), len(one) - int(one.sum())))
            values = np.concatenate([values[~one], values[one]])
        edge = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
        self.start = np.zeros(n_symbols, np.int64)
        self.start[values[edge]] = edge

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol comes before each place."""
        for shift, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at - self.start[symbol]

    def symbol(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it comes before."""
        out = np.zeros(len(at), np.int64)
        for _, bits, zeros in self.levels:
            one, ones = bits.get(at), bits.ones(at)
            out = out << 1 | one
            at = np.where(one, zeros + ones, at - ones)
        return out, at - self.start[out]


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in their order; the last symbol must occur once. Ranks of 1, 3, 9, ... symbols are
    made of three ranks each, for those suffixes that are still equal to another."""
    n = len(symbols)
    rank = np.zeros(n + 2, np.int64)
    rank[:n] = symbols + 1
    key = rank[:n] << 42 | rank[1 : n + 1] << 21 | rank[2 : n + 2]
    order, slots, step = np.argsort(key), np.arange(n), 1
    tied = order
    while True:
        key = key[tied] if step == 1 else key
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.maximum.accumulate(np.where(new, slots, 0))
        rank[tied] = group + 1
        alone = new & np.concatenate([new[1:], [True]])
        slots, tied, step = slots[~alone], tied[~alone], step * 3
        if not len(tied):
            return order
        at = rank[tied] << 42 | rank[np.minimum(tied + step, n)] << 21 | rank[np.minimum(tied + 2 * step, n)]
        by = np.argsort(at)
        key, tied = at[by], tied[by]
        order[slots] = tied


class FmIndex:
    def __init__(self, symbols: np.ndarray, n_symbols: int):
        """symbols: below n_symbols, at most MOST of them, the last occurring once."""
        if len(symbols) > MOST:
            raise ValueError(f"an index holds at most {MOST} symbols")
        order = suffix_order(symbols)
        count = np.bincount(symbols, minlength=n_symbols)
        self.first = np.cumsum(count) - count
        self.size = len(symbols)
        self.wavelet = WaveletMatrix(symbols[order - 1], n_symbols)
        kept = order % SAMPLE == 0
        self.marks, self.places = Bits(kept), order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that start with each phrase. phrases: a row each, the last symbol first;
        symbols below zero occur nowhere."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for k in range(phrases.shape[1]):
            on = np.flatnonzero((lengths > k) & (low < high))
            c = phrases[on, k]
            high[on[c < 0]] = 0
            low[on[c < 0]] = 0
            on, c = on[c >= 0], c[c >= 0]
            both = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([low[on], high[on]]))
            low[on], high[on] = self.first[c] + both[: len(on)], self.first[c] + both[len(on) :]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of some rows start: steps back in the text until a row whose place is kept."""
        out, left, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(left):
            known = self.marks.get(rows)
            out[left[known]] = self.places[self.marks.ones(rows[known])] + steps
            left, rows, steps = left[~known], rows[~known], steps + 1
            c, before = self.wavelet.symbol(rows)
            rows = self.first[c] + before
        return out
