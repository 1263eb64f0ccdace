"""Random draws by counting: each number is a hash of a seed, the draw and a place in it, so any engine, task or retry gives the same one, in any order.

The hash mixes 32-bit words by two multiplications and three shifts (the constants below).
"""

from __future__ import annotations

import hashlib

import numpy as np

DRAW, PLACE = 0x9E3779B9, 0x85EBCA6B
FACTORS = (0x7FEB352D, 0x846CA68B)


def seed_of(*parts: object) -> int:
    """32 bits of the parts' text, which SQL can take from md5 as well."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint32)
    x ^= x >> np.uint32(16)
    x *= np.uint32(FACTORS[0])
    x ^= x >> np.uint32(15)
    x *= np.uint32(FACTORS[1])
    x ^= x >> np.uint32(16)
    return x


def words(seed: int, first: int, draws: int, places: int) -> np.ndarray:
    """(draws, places) words of the draws from number `first` on."""
    each = mix((seed + (np.arange(first, first + draws, dtype=np.uint64) * DRAW)) & 0xFFFFFFFF)
    return mix((each[:, None].astype(np.uint64) + np.arange(places, dtype=np.uint64) * PLACE) & 0xFFFFFFFF)


def integers(seed: int, first: int, draws: int, places: int, below: int) -> np.ndarray:
    """(draws, places) numbers from 0 to below - 1."""
    return (words(seed, first, draws, places) % np.uint32(below)).astype(np.int64)


def orders(seed: int, first: int, draws: int, n: int) -> np.ndarray:
    """(draws, n) random orders of 0..n-1."""
    return np.argsort(words(seed, first, draws, n), axis=1, kind="stable")
