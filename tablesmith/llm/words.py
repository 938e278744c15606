"""Words of many texts at once, as 64-bit hashes in one array."""

from __future__ import annotations

from functools import cache

import numpy as np

# Bytes inside a word: all but white space, or letters and digits (bytes of other scripts count as letters).
_BLANKS = bytes([0x20, *range(0x09, 0x0E)])
_SPELL = 1024  # places with a multiplier of their own; they repeat beyond, mixed with the length


@cache
def word_bytes(letters_only: bool) -> np.ndarray:
    table = np.ones(256, bool)
    if letters_only:
        table[:0x80] = [chr(b).isalnum() for b in range(0x80)]
    table[list(_BLANKS)] = False
    return table


@cache
def _multipliers() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 2**63, _SPELL, np.uint64) << np.uint64(1) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(texts: list[bytes], letters_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and where each text's begin (one more entry for the end).

    Two different words share a hash with a chance of about 2**-64 for each pair.
    """
    return spelled_words(texts, letters_only)[:2]


def spelled_words(texts: list[bytes], letters_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and bounds as in ``hash_words``, and the bytes in which each word starts and ends."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = word_bytes(letters_only)[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    lengths = np.array([len(t) + 1 for t in texts])
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths)))) if len(texts) else np.zeros(1, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds, data, starts, ends
    spans = ends - starts
    at = np.flatnonzero(inside)
    first = np.cumsum(spans) - spans
    place = np.arange(len(at)) - np.repeat(first, spans)
    sums = np.add.reduceat((data[at].astype(np.uint64) + np.uint64(1)) * _multipliers()[place % _SPELL], first)
    return mix(sums + mix(spans.astype(np.uint64))), bounds, data, starts, ends


def windows(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words inside one text, and the index of their first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total = mix(total + words[j : j + n] + np.uint64(j))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(text[:n] == text[size - 1 :])
    return total[at], at
