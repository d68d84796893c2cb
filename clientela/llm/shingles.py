"""Word shingles of documents, their hashes and their MinHash signatures."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
VALUES = 64
BINS = 1024

_random = np.random.default_rng(20)
_ODD = (_random.integers(0, 2**63, VALUES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_MASK = _random.integers(0, 2**63, VALUES, dtype=np.uint64)
_PLACE = (_random.integers(0, 2**63, SHINGLE, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_TOP = np.uint64(64 - BINS.bit_length() + 1)
_EDGES = np.arange(BINS, dtype=np.uint64) << _TOP


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text.

    Words are runs of anything but ASCII white space, A-Z in lower case. Fewer
    than five words are one shingle, no words none. Two different shingles of a
    pair of texts with n shingles share a hash with probability n * n / 2**65.
    """
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, text.lower().split()), np.uint64)
    if not len(words):
        return words
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(words.tobytes(), seed=1)], np.uint64)
    count = len(words) - SHINGLE + 1
    hashes = np.zeros(count, np.uint64)
    for place in range(SHINGLE):
        hashes = mixed(hashes + words[place : place + count] * _PLACE[place])
    return np.unique(hashes)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of 64 independent minima; two sets agree in a value with
    the probability of their Jaccard similarity, or by chance once in 65536."""
    smallest = np.full(VALUES, np.uint64(2**64 - 1))
    for start in range(0, len(shingles), 4096):
        block = (shingles[start : start + 4096, None] ^ _MASK) * _ODD
        smallest = np.minimum(smallest, block.min(axis=0))
    return mixed(smallest).astype(np.uint16)


def bins(shingles: np.ndarray) -> np.ndarray:
    """One byte per 1024th of the hash range: from the smallest hash in it, 0 if none."""
    first = np.searchsorted(shingles, _EDGES)
    value = shingles[np.minimum(first, len(shingles) - 1)]
    filled = (first < len(shingles)) & (value >> _TOP == _EDGES >> _TOP)
    return np.where(filled, value % np.uint64(255) + np.uint64(1), 0).astype(np.uint8)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the intersection is at least ``percent`` of the union, exactly."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared > 0 and 100 * shared >= percent * (len(a) + len(b) - shared)
