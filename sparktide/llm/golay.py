"""The perfect binary Golay code of 23 bits: keys that vectors differing in two bits share.

Every 23-bit vector is within three bits of exactly one codeword.  The keys of a vector are
the indices of the codewords within four bits when the nearest is three away (six of them),
else of the nearest alone.  A vector halfway between two that differ in at most two bits is at
most one bit from either, and its own nearest codeword is then a key of both.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH = 23
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _remainder(vectors: np.ndarray) -> np.ndarray:
    rest = vectors.copy()
    for bit in range(LENGTH - 1, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def _patterns() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome, up to six error patterns that lead to codewords, and how many."""
    found: list[list[int]] = [[] for _ in range(2048)]
    weights: list[int] = [9] * 2048
    for weight in range(5):
        errors = np.array([sum(1 << k for k in c) for c in combinations(range(LENGTH), weight)], np.int64)
        for e, s in zip(errors.tolist(), _remainder(errors).tolist(), strict=True):
            weights[s] = min(weights[s], weight)
            if weight <= 3 or weights[s] == 3:
                found[s].append(e)
    table = np.zeros((2048, 6), np.int64)
    for s, es in enumerate(found):
        table[s, : len(es)] = es
    return table, np.array([len(es) for es in found])


ERRORS, COUNTS = _patterns()


def keys(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices (12 bits each) of 23-bit vectors: six columns, and how many hold."""
    s = _remainder(vectors.astype(np.int64))
    return (vectors[:, None] ^ ERRORS[s]) >> 11, COUNTS[s]
