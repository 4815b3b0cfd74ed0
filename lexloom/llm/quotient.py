"""Counting quotient filters without loss: n-grams of word numbers are packed into one number, which an invertible
permutation spreads; its first bits (the quotient) are implied by the place in the filter, the rest (the remainder) is stored in full
beside a counter. Filters are sorted by the permuted number, so that filters of shards are merged in order."""

from __future__ import annotations

import numpy as np

#: Bits of a word's number; five of them fit into two halves of up to 63 bits.
WORD_BITS, MOST_WORDS = 25, 5
_ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_U = np.uint64


def _spread(x: np.ndarray, odd: int) -> np.ndarray:
    x = (x + _U(1)) * _U(odd)
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    return x ^ x >> _U(32)


def _halves(words: int) -> tuple[int, int]:
    """Bits of the left and the right half."""
    bits = words * WORD_BITS
    return bits - bits // 2, bits // 2


def packed(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Halves of the numbers that word numbers, one array for each place, are packed into."""
    high, low = np.zeros(len(columns[0]), _U), np.zeros(len(columns[0]), _U)
    for c in columns:
        high = high << _U(WORD_BITS) | low >> _U(64 - WORD_BITS)
        low = low << _U(WORD_BITS) | c.astype(_U)
    _, right = _halves(len(columns))
    return high << _U(64 - right) | low >> _U(right), low & _U((1 << right) - 1)


def unpacked(left: np.ndarray, right: np.ndarray, words: int) -> np.ndarray:
    """packed() undone: a row of word numbers for each number."""
    bits = _halves(words)[1]
    high, low = left >> _U(64 - bits), left << _U(bits) | right
    out = np.empty((len(left), words), np.int64)
    for k in reversed(range(words)):
        out[:, k] = low & _U((1 << WORD_BITS) - 1)
        low = low >> _U(WORD_BITS) | high << _U(64 - WORD_BITS)
        high = high >> _U(WORD_BITS)
    return out


def permuted(left: np.ndarray, right: np.ndarray, words: int, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Each half is changed by what the other one spreads to, in turn; undone in reverse order."""
    a, b = (_U((1 << n) - 1) for n in _halves(words))
    steps = list(enumerate(_ROUNDS))
    with np.errstate(over="ignore"):
        for i, odd in reversed(steps) if back else steps:
            if i % 2:
                right = right ^ _spread(left, odd) & b
            else:
                left = left ^ _spread(right, odd) & a
    return left, right


class QuotientFilter:
    """Sorted permuted numbers of n-grams of `words` words, and how often each came."""

    def __init__(self, words: int, left: np.ndarray, right: np.ndarray, counts: np.ndarray):
        self.words, self.left, self.right, self.counts = words, left, right, counts

    @classmethod
    def counted(cls, words: int, left: np.ndarray, right: np.ndarray, counts: np.ndarray | None = None) -> QuotientFilter:
        """From permuted numbers in any order, equal ones added up."""
        a, b = _halves(words)
        if a + b < 64:
            order = np.argsort(left << _U(b) | right)
        else:
            order = np.lexsort((right, left))
        left, right = left[order], right[order]
        edge = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])])) if len(left) else np.empty(0, np.int64)
        counts = np.diff(np.concatenate([edge, [len(left)]])) if counts is None else (np.add.reduceat(counts[order], edge) if len(edge) else counts)
        return cls(words, left[edge], right[edge], counts.astype(np.int64))

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        if len(filters) == 1:
            return filters[0]
        return cls.counted(filters[0].words, *(np.concatenate([getattr(f, x) for f in filters]) for x in ("left", "right", "counts")))

    def grams(self) -> np.ndarray:
        return unpacked(*permuted(self.left, self.right, self.words, back=True), self.words)

    def split(self, bits: int) -> list[tuple[int, QuotientFilter]]:
        """By the first `bits` bits: (part, filter) of the parts that aren't empty."""
        part = (self.left >> _U(_halves(self.words)[0] - bits)).astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
        ends = [*edge[1:], len(part)] if len(part) else []
        return [(int(part[x]), QuotientFilter(self.words, self.left[x:y], self.right[x:y], self.counts[x:y])) for x, y in zip(edge, ends, strict=True)]

    def to_bytes(self, part_bits: int = 0) -> bytes:
        """Head (words, quotient bits, part bits, size, first part), occupied quotients, ends of runs, remainders, counters.

        A quotient has about as many bits as tell the entries of the part apart. A counter is a byte; 255 says that
        eight bytes for it follow at the end."""
        a, b = _halves(self.words)
        n = len(self.left)
        q = min(a, part_bits + max(3, int(n).bit_length()))
        quotient = (self.left >> _U(a - q)).astype(np.int64)
        base = int(quotient[0] >> (q - part_bits)) if n else 0
        quotient = quotient - (base << (q - part_bits))
        occupied = np.zeros(1 << (q - part_bits), bool)
        occupied[quotient] = True
        ends = np.concatenate([quotient[1:] != quotient[:-1], [True]]) if n else np.empty(0, bool)
        rest = self.left & _U((1 << (a - q)) - 1)
        wide = np.stack([rest, self.right], axis=1).astype(">u8").view(np.uint8).reshape(n, 16)
        keep = [*range(8 - (a - q + 7) // 8, 8), *range(16 - (b + 7) // 8, 16)]
        small = np.minimum(self.counts, 255).astype(np.uint8)
        head = np.array([self.words, q, part_bits, n, base], "<i8").tobytes()
        return b"".join([head, np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), np.ascontiguousarray(wide[:, keep]).tobytes(), small.tobytes(), self.counts[small == 255].astype("<i8").tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        words, q, part_bits, n, base = (int(x) for x in np.frombuffer(data, "<i8", 5))
        a, b = _halves(words)
        at = 40
        size = 1 << (q - part_bits)
        occupied = np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at), count=size)
        at += -(-size // 8)
        ends = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n)
        at += -(-n // 8)
        quotient = np.flatnonzero(occupied)[np.cumsum(ends) - ends] + (base << (q - part_bits))
        keep = [*range(8 - (a - q + 7) // 8, 8), *range(16 - (b + 7) // 8, 16)]
        wide = np.zeros((n, 16), np.uint8)
        wide[:, keep] = np.frombuffer(data, np.uint8, n * len(keep), at).reshape(n, len(keep))
        at += n * len(keep)
        both = wide.view(">u8").astype(_U)
        counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
        many = counts == 255
        counts[many] = np.frombuffer(data, "<i8", int(many.sum()), at + n)
        return cls(words, quotient.astype(_U) << _U(a - q) | both[:, 0], both[:, 1].copy(), counts)
