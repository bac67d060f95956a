"""Counting quotient filters over permuted keys, lossless because quotient and full remainder are kept.

A key is ``length`` word numbers of ``bits`` bits each, packed into two halves of ``half`` bits. A
Feistel network permutes the pair (it can be inverted, so no two keys collide and every key can be
read back). The permuted key is a slice number (the shard that merges it), a quotient and a
remainder. A filter holds the entries of one slice in order of (quotient, remainder): a bitmap of
the quotients that occur, a bitmap of the last entries of each quotient's run, the remainders at
their byte width, and counters of one byte (larger ones spill into a list).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

ROUNDS = 4
#: Odd multipliers of the round functions (any odd numbers would do).
MULTIPLIERS = tuple(0x9E3779B97F4A7C15 * (2 * r + 1) % (1 << 64) for r in range(ROUNDS))
#: A half is shifted and multiplied in 64 bits.
MOST_HALF = 62


class Packing(NamedTuple):
    """How n-grams of ``length`` word numbers below 2^``bits`` become keys of two halves."""

    length: int
    bits: int

    @property
    def half(self) -> int:
        return -(-self.length * self.bits // 2)

    def pack(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(left, right) of n-grams given as one array of numbers for each place."""
        high, low = np.zeros(len(words[0]), np.uint64), np.zeros(len(words[0]), np.uint64)
        for word in words:  # shift the pair left by ``bits``, put the word in
            high = ((high << np.uint64(self.bits)) | (low >> np.uint64(self.half - self.bits))) & self.mask
            low = ((low << np.uint64(self.bits)) & self.mask) | word.astype(np.uint64)
        return high, low

    def unpack(self, high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
        words = []
        for _ in range(self.length):
            words.append(low & np.uint64((1 << self.bits) - 1))
            low = (low >> np.uint64(self.bits)) | ((high << np.uint64(self.half - self.bits)) & self.mask)
            high = high >> np.uint64(self.bits)
        return words[::-1]

    @property
    def mask(self) -> np.uint64:
        return np.uint64((1 << self.half) - 1)

    def _round(self, x: np.ndarray, r: int) -> np.ndarray:
        x = (x + np.uint64(r + 1)) * np.uint64(MULTIPLIERS[r])
        x ^= x >> np.uint64(32)
        x *= np.uint64(MULTIPLIERS[(r + 1) % ROUNDS])
        return (x >> np.uint64(64 - self.half)) & self.mask

    def permute(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for r in range(ROUNDS):
            left, right = right, left ^ self._round(right, r)
        return left, right

    def invert(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for r in reversed(range(ROUNDS)):
            left, right = right ^ self._round(left, r), left
        return left, right


def combined(half: int, left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts added up."""
    if not len(left):
        return left, right, counts
    if 2 * half <= 64:
        order = np.argsort((left << np.uint64(half)) | right)
    else:
        order = np.lexsort((right, left))
    left, right, counts = left[order], right[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
    return left[first], right[first], np.add.reduceat(counts, first)


def _narrow(x: np.ndarray, width: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _wide(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel().astype(np.uint64)


class QuotientFilter(NamedTuple):
    """One slice's entries. Keys are permuted; the left half starts with the ``slice_bits`` of the slice."""

    half: int
    slice_bits: int
    slice_number: int
    quotient_bits: int
    size: int
    occupied: bytes
    run_ends: bytes
    low: bytes  # rest of the left half
    high: bytes  # the right half
    counters: bytes
    large: bytes

    @classmethod
    def of(cls, half: int, slice_bits: int, slice_number: int, left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> QuotientFilter:
        """From distinct keys of the slice, in order."""
        n = len(left)
        q = min(half - slice_bits, max(0, n.bit_length() - 1))
        rest = half - slice_bits - q
        inside = left & np.uint64((1 << (half - slice_bits)) - 1)
        quotient = (inside >> np.uint64(rest)).astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        ends = np.ones(n, bool)
        ends[:-1] = quotient[1:] != quotient[:-1]
        return cls(half, slice_bits, slice_number, q, n, np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(),
                   _narrow(inside & np.uint64((1 << rest) - 1), -(-rest // 8)) if rest else b"", _narrow(right, -(-half // 8)),
                   np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[counts >= 255].astype("<i8").tobytes())

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(left, right, count) in order: the quotient of an entry is the occupied one of its run's number."""
        rest = self.half - self.slice_bits - self.quotient_bits
        ends = np.unpackbits(np.frombuffer(self.run_ends, np.uint8), count=self.size).astype(bool)
        run = np.cumsum(ends) - ends
        quotients = np.flatnonzero(np.unpackbits(np.frombuffer(self.occupied, np.uint8), count=1 << self.quotient_bits)).astype(np.uint64)
        left = quotients[run] << np.uint64(rest)
        if rest:
            left = left | _wide(self.low, -(-rest // 8))
        left = left | np.uint64(self.slice_number << (self.half - self.slice_bits))
        counts = np.frombuffer(self.counters, np.uint8).astype(np.int64)
        counts[counts == 255] = np.frombuffer(self.large, "<i8")
        return left, _wide(self.high, -(-self.half // 8)), counts

    def nbytes(self) -> int:
        return sum(len(x) for x in self[5:])


def slices(packing: Packing, slice_bits: int, left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> list[QuotientFilter]:
    """Filters of the slices that occur among distinct permuted keys in order."""
    number = (left >> np.uint64(packing.half - slice_bits)).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(left)]
    return [QuotientFilter.of(packing.half, slice_bits, int(number[a]), left[a:b], right[a:b], counts[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def merged(filters: list[QuotientFilter]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries of several filters of one slice, in order, with counts added up."""
    parts = [f.entries() for f in filters]
    return combined(filters[0].half, *(np.concatenate(x) for x in zip(*parts)))
