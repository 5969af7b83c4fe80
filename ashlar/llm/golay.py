"""The perfect binary Golay code of 23 bits: every word is within three bits of one codeword."""

from __future__ import annotations

from itertools import combinations

import numpy as np

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 divides x^23 - 1.
GENERATOR, LENGTH, CHECKS = 0b110001110101, 23, 11


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of each byte at its three places, and the error of at most three bits that leaves each remainder."""
    parts = np.array([[_remainder(byte << shift) if byte << shift < 1 << LENGTH else 0 for byte in range(256)] for shift in (0, 8, 16)], np.uint32)
    unit = [_remainder(1 << bit) for bit in range(LENGTH)]
    errors = np.zeros(1 << CHECKS, np.uint32)
    for weight in (1, 2, 3):
        for bits in combinations(range(LENGTH), weight):
            left = 0
            for bit in bits:
                left ^= unit[bit]
            errors[left] = sum(1 << bit for bit in bits)
    return parts, errors


_PARTS, _ERRORS = _tables()


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each word."""
    words = words.astype(np.uint32)
    left = _PARTS[0][words & 255] ^ _PARTS[1][words >> 8 & 255] ^ _PARTS[2][words >> 16]
    return (words ^ _ERRORS[left]) >> CHECKS


def nearby(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices decoded from each word and from it with any one of its low width bits flipped: (places in words, indices).

    Words that differ in one bit: the index of either is among those nearby the other. Words that differ in two bits have
    an index nearby both. A word has one such index, or six or fewer where it is three bits off its codeword.
    """
    flips = np.concatenate([[0], 1 << np.arange(width)]).astype(np.uint32)
    found = np.sort(decode(words.astype(np.uint32)[:, None] ^ flips), axis=1)
    first = np.ones(found.shape, bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    place, column = np.nonzero(first)
    return place, found[place, column]
