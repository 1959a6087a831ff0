"""The perfect binary Golay code of length 23, for fuzzy keys.

Every word of 23 bits lies within three bits of exactly one of the 4096 codewords. A word's keys are
the indices of all codewords within four bits of it: the nearest one, and, when that is three bits
away, the five that are four bits away. A word one bit off lies within four bits of the first word's
nearest codeword, so two words that differ in one bit or none always share a key.

Where more is known of each bit than its sign, nearest() takes the codewords of highest correlation with the
bits' margins instead: unsure bits weigh little, so words that differ in several unsure bits still meet.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
MOST_KEYS = 6


def remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low and high half of a word; for each remainder its error patterns (-1: none)."""
    low = np.array([remainder(w) for w in range(1 << 12)], np.int64)
    high = np.array([remainder(w << 12) for w in range(1 << 11)], np.int64)
    patterns = np.full((1 << 11, MOST_KEYS), -1, np.int64)
    filled = np.zeros(1 << 11, np.int64)
    weight = np.zeros(1 << 11, np.int64)
    for errors in range(5):
        for bits in combinations(range(23), errors):
            e = sum(1 << b for b in bits)
            r = remainder(e)
            if errors < 4:
                weight[r] = errors
            elif weight[r] != 3:
                continue
            patterns[r, filled[r]] = e
            filled[r] += 1
    return low, high, patterns, filled


def keys(words: np.ndarray) -> np.ndarray:
    """For each word of up to 23 bits its codeword indices, -1 beyond the last."""
    low, high, patterns, _ = tables()
    words = words.astype(np.int64)
    errors = patterns[low[words & 0xFFF] ^ high[words >> 12]]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


@cache
def codewords() -> np.ndarray:
    """All codewords in the order of their indices, a row each, bits as 1 and -1."""
    words = np.array([(m << 11) ^ remainder(m << 11) for m in range(1 << 12)], np.int64)
    return (2 * (words[:, None] >> np.arange(23) & 1) - 1).astype(np.float32)


def nearest(margins: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k codewords of highest correlation with each row of 23 margins, best first."""
    found = np.empty((len(margins), k), np.int64)
    for first in range(0, len(margins), 256):
        some = margins[first : first + 256].astype(np.float32) @ codewords().T
        rows = np.arange(len(some))
        for i in range(k):
            best = some.argmax(axis=1)
            found[first : first + len(some), i] = best
            some[rows, best] = -np.inf
    return found
