"""Vectorised words and word shingles as 64-bit hashes, for use inside tasks.

A word's hash is a polynomial of its bytes over random odd 64-bit values, mixed afterwards; a
shingle's hash mixes those of its words in order. Hashes only meet within one pair of texts or
are checked again, so a collision needs two of the few thousand shingles of one pair.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
AS_THEY_ARE = np.arange(256, dtype=np.uint8)


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: bytes, letters_as: np.ndarray = _LOWER) -> np.ndarray:
    """Hashes of the words of a text, A-Z in lower case unless ``letters_as`` says otherwise."""
    raw = np.frombuffer(text, np.uint8)
    inside = ~_SPACES[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    letters = raw[inside]
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    powers = np.full(int(lengths.max()), _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    values = _BYTE[letters_as[letters]] * powers[place]
    return mix64(np.add.reduceat(values, first) + lengths.astype(np.uint64))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, by place."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _BASE + words[j:j + n]
    return mix64(out + np.uint64(k))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingles as int64; a shorter text is one shingle, one without words none."""
    words = word_hashes(text.encode()) if text else np.zeros(0, np.uint64)
    if not len(words):
        return np.zeros(0, np.int64)
    return np.unique(grams(words, min(k, len(words))).view(np.int64))
