"""The binary Golay code (23, 12, 7): every 23-bit word lies within distance 3
of exactly one codeword. Words at distance 2 or less share a decoded neighbour,
so a word's keys are the codewords of its ball of radius 1: one or six."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, a fixed value of the code.
GENERATOR = 0b101011100011
LENGTH, CHECK = 23, 11


def _remainders(values: np.ndarray) -> np.ndarray:
    out = values.astype(np.uint32)
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        out = np.where(out >> bit & 1, out ^ np.uint32(GENERATOR << bit - CHECK), out)
    return out


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, and the error of each syndrome."""
    low = _remainders(np.arange(1 << 12))
    high = _remainders(np.arange(1 << 11, dtype=np.uint32) << 12)
    errors = np.array([0] + [sum(1 << b for b in c) for w in (1, 2, 3) for c in combinations(range(LENGTH), w)], dtype=np.uint32)
    table = np.zeros(1 << CHECK, dtype=np.uint32)
    table[_remainders(errors)] = errors
    return low, high, table


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword within distance 3 of each 23-bit word."""
    low, high, errors = _tables()
    words = words.astype(np.uint32)
    return (words ^ errors[low[words & 0xFFF] ^ high[words >> 12]]) >> np.uint32(CHECK)


def keys(words: np.ndarray) -> np.ndarray:
    """(n, 24) codeword indices of each word and its 23 neighbours, sorted."""
    flips = np.concatenate([[0], 1 << np.arange(LENGTH)]).astype(np.uint32)
    return np.sort(decode(words.astype(np.uint32)[:, None] ^ flips[None, :]), axis=1)
