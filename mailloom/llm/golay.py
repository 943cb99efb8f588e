"""Decoding of 23-bit words to nearby codewords of the binary Golay code.

The code is perfect: each word is within 3 bits of exactly one codeword. Words that are exactly 3 away have five more
codewords at distance 4, all others none. Two words at most 2 bits apart share a codeword within 4 bits of both: the
one that is nearest to the word halfway.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

BITS, DATA = 23, 12
CHECK = BITS - DATA
#: Fixed value: the generator x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
WAYS = 6


def remainder(word: int) -> int:
    for bit in range(BITS - 1, CHECK - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK)
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and of the high 11 bits, error patterns by remainder, number of patterns."""
    single = np.array([remainder(1 << bit) for bit in range(BITS)])
    low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
    for bit in range(12):
        low ^= np.where(np.arange(1 << 12) >> bit & 1, single[bit], 0)
    for bit in range(11):
        high ^= np.where(np.arange(1 << 11) >> bit & 1, single[12 + bit], 0)
    patterns, ways = np.zeros((1 << CHECK, WAYS), np.int64), np.zeros(1 << CHECK, np.int64)
    for weight in range(5):
        for bits in combinations(range(BITS), weight):
            at = int(np.bitwise_xor.reduce(single[list(bits)])) if bits else 0
            if weight < 4 or ways[at] and bin(patterns[at, 0]).count("1") == 3:
                patterns[at, ways[at]] = sum(1 << bit for bit in bits)
                ways[at] += 1
    return low, high, patterns, ways


def decode(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words -> numbers of the codewords within 4 bits (n x 6, the nearest first), and how many there are."""
    low, high, patterns, ways = tables()
    words = words.astype(np.int64)
    at = low[words & 0xFFF] ^ high[words >> 12]
    return (words[:, None] ^ patterns[at]) >> CHECK, ways[at]
