"""The perfect binary (23, 12) Golay code, vectorised: nearest codewords as fuzzy hash keys."""

from __future__ import annotations

from itertools import combinations

import numpy as np

#: Generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
LENGTH, CHECK_BITS = 23, 11


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK_BITS)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray]:
    high = np.array([_remainder(x << CHECK_BITS) for x in range(1 << (LENGTH - CHECK_BITS))], dtype=np.int64)
    leaders = np.zeros(1 << CHECK_BITS, dtype=np.int64)
    for weight in range(1, 4):
        for bits in combinations(range(LENGTH), weight):
            error = sum(1 << b for b in bits)
            leaders[_remainder(error)] = error
    return high, leaders


_HIGH, _LEADERS = _tables()


def nearest(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the only codeword within distance 3 of each 23-bit word."""
    syndrome = _HIGH[words >> CHECK_BITS] ^ (words & ((1 << CHECK_BITS) - 1))
    return (words ^ _LEADERS[syndrome]) >> CHECK_BITS


def nearby(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords nearest to each word or to a word one bit (of the lowest ``width``) away, and a mask
    of the distinct ones. Two words at distance 2 or less have one of these in common: that of a word between them."""
    flips = np.concatenate(([0], 1 << np.arange(width, dtype=np.int64)))
    found = np.sort(nearest(words[:, None] ^ flips[None, :]), axis=1)
    fresh = np.ones(found.shape, dtype=bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    return found, fresh
