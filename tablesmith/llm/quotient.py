"""Counting quotient filters: lossless, compact, mergeable counters of fixed-width keys.

A key of ``width`` bits is permuted by an invertible Feistel network. The upper bits of what comes out
are its quotient, all others its remainder, so quotient and remainder together give the key back and
nothing is ever confused. A filter keeps the remainders sorted by quotient: a unary row of bits says
how many each quotient holds, remainders are stored in whole bytes, counters in one byte each with
larger ones beside. Two filters are merged by merging their sorted keys and adding counters.

Keys are pairs of arrays (``high``, ``low``) of unsigned 64-bit integers, each half of the width.
"""

from __future__ import annotations

import struct

import numpy as np

from tablesmith.llm.words import mix

MAX_WIDTH = 128
_ROUNDS = tuple(np.uint64(int(x)) for x in np.random.default_rng(12).integers(1, 2**63, 4))
_HEAD = struct.Struct("<IHHI")  # entries, half width, quotient bits, large counters
_LARGE = 255

Keys = tuple[np.ndarray, np.ndarray]


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def permute(keys: Keys, half: int) -> Keys:
    """A bijection of pairs of ``half``-bit numbers."""
    left, right = keys
    for k in _ROUNDS:
        left, right = right, left ^ (mix(right + k) & _mask(half))
    return left, right


def restore(keys: Keys, half: int) -> Keys:
    left, right = keys
    for k in reversed(_ROUNDS):
        left, right = right ^ (mix(left + k) & _mask(half)), left
    return left, right


def _shifted(values: np.ndarray, bits: int) -> np.ndarray:
    return values << np.uint64(bits) if bits < 64 else np.zeros_like(values)


def _ordered(keys: Keys, half: int) -> tuple[np.ndarray, Keys]:
    """The sorting order, and the keys in it."""
    left, right = keys
    if half <= 32:
        order = np.argsort(_shifted(left, half) | right)
    else:
        # the upper 64 bits decide nearly always; the others only among equals
        upper = _shifted(left, 64 - half) | right >> np.uint64(2 * half - 64)
        order = np.argsort(upper)
        a, b = upper[order], right[order]
        if ((a[1:] == a[:-1]) & (b[1:] < b[:-1])).any():
            order = np.lexsort((right, left))
    return order, (left[order], right[order])


def _summed(keys: Keys, counts: np.ndarray, half: int) -> tuple[Keys, np.ndarray]:
    """Distinct keys in sorted order with the sums of their counts."""
    if not len(counts):
        return keys, counts
    order, (left, right) = _ordered(keys, half)
    first = np.flatnonzero(np.concatenate(([True], (left[1:] != left[:-1]) | (right[1:] != right[:-1]))))
    return (left[first], right[first]), np.add.reduceat(counts[order], first)


def count(keys: Keys, half: int) -> tuple[Keys, np.ndarray]:
    """The permuted distinct ``keys`` in sorted order, and how often each occurs."""
    left, right = permute(keys, half)
    if half > 32 or not len(left):
        return _summed((left, right), np.ones(len(left), np.int64), half)
    flat = np.sort(_shifted(left, half) | right)
    first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    flat = flat[first]
    return (flat >> np.uint64(half), flat & _mask(half)), np.diff(np.append(first, len(left)))


def merge(filters: list[tuple[Keys, np.ndarray]], half: int) -> tuple[Keys, np.ndarray]:
    """One filter of several, decoded, with counters added."""
    if len(filters) == 1:
        return filters[0]
    left, right = (np.concatenate([f[0][i] for f in filters]) for i in (0, 1))
    return _summed((left, right), np.concatenate([f[1] for f in filters]), half)


def _bytes_of(values: np.ndarray, bits: int) -> bytes:
    """Numbers of ``bits`` bits in whole bytes, plane by plane."""
    return b"".join((values >> np.uint64(8 * i)).astype(np.uint8).tobytes() for i in range(-(-bits // 8)))


def _numbers(data: memoryview, n: int, bits: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    for i in range(-(-bits // 8)):
        out |= np.frombuffer(data[i * n : (i + 1) * n], np.uint8).astype(np.uint64) << np.uint64(8 * i)
    return out


def pack(keys: Keys, counts: np.ndarray, half: int) -> bytes:
    """A filter as bytes. ``keys`` are permuted, distinct and sorted."""
    n = len(counts)
    q = min(max(n, 1).bit_length(), half)
    left, right = keys
    quotient = (left >> np.uint64(half - q)).astype(np.int64)
    bits = np.zeros(n + (1 << q), bool)  # a one for each key, a zero after each quotient
    bits[np.arange(n) + quotient] = True
    large = np.flatnonzero(counts >= _LARGE)
    small = np.minimum(counts, _LARGE).astype(np.uint8)
    return b"".join((
        _HEAD.pack(n, half, q, len(large)), np.packbits(bits).tobytes(), _bytes_of(left & _mask(half - q), half - q), _bytes_of(right, half),
        small.tobytes(), counts[large].astype("<i8").tobytes(),
    ))


def unpack(data: bytes) -> tuple[Keys, np.ndarray]:
    """The permuted keys, sorted, and the counts of a packed filter."""
    view = memoryview(data)
    n, half, q, large = _HEAD.unpack_from(view)
    at = _HEAD.size
    size = -(-(n + (1 << q)) // 8)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(view[at : at + size], np.uint8), count=n + (1 << q)))
    quotient = (ones - np.arange(n)).astype(np.uint64)
    at += size
    low = _numbers(view[at:], n, half - q)
    at += n * -(-(half - q) // 8)
    right = _numbers(view[at:], n, half)
    at += n * -(-half // 8)
    counts = np.frombuffer(view[at : at + n], np.uint8).astype(np.int64)
    counts[counts == _LARGE] = np.frombuffer(view[at + n : at + n + 8 * large], "<i8")
    return (quotient << np.uint64(half - q) | low, right), counts


def shards(keys: Keys, half: int, bits: int) -> np.ndarray:
    """Where each of 2**``bits`` equal ranges of permuted keys ends in the sorted ``keys``."""
    edges = np.arange(1, (1 << bits) + 1, dtype=np.uint64)
    top = keys[0] >> np.uint64(half - bits)
    return np.searchsorted(top, edges)
