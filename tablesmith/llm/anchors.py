"""Content-defined regions: where two texts share 100 bytes, both show a region with one anchor.

The anchor of a window is its 24-byte string of least hash, the rightmost among equals. Equal windows
have their anchor at the same offset, so windows are compared only inside regions, the runs of
windows that share an anchor's place, and only between regions whose anchors are equal. Within one
region no two windows are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from tablesmith.llm.words import mix

GRAM = 24
GROUP_BYTES = 1 << 18
_MULTIPLIERS = np.random.default_rng(7).integers(1, 2**63, 3, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = int(np.random.default_rng(8).integers(1, 2**61)) * 8 + 5


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    out = []
    for base in (_STEP, pow(_STEP, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def regions(data: bytes, ends: np.ndarray, size: int = 100) -> dict[str, np.ndarray]:
    """The regions of texts laid end to end: ``text``, ``start`` and ``place`` of the anchor (in its text), ``length``, ``anchor``, ``content`` (hash)."""
    b = np.frombuffer(data, np.uint8)
    n = len(b)
    none = np.zeros(0, np.int64)
    if n < size:
        return {"text": none, "start": none, "place": none, "length": none, "anchor": none.astype(np.uint64), "content": none.astype(np.uint64)}
    x = b.astype(np.uint64)
    for width in (1, 2, 4):
        x = x[:-width] | x[width:] << np.uint64(8 * width)
    grams = n - GRAM + 1
    h = mix(x[:grams] * _MULTIPLIERS[0] + mix(x[8 : 8 + grams] * _MULTIPLIERS[1] + x[16 : 16 + grams] * _MULTIPLIERS[2]))
    bits = n.bit_length()
    low = np.uint64((1 << bits) - 1)
    key = (h & ~low) | (low - np.arange(grams, dtype=np.uint64))
    span, width = size - GRAM + 1, 1
    while 2 * width <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if span > width:
        key = np.minimum(key[: width - span], key[span - width :])
    place = (low - (key & low)).astype(np.int64)  # of the anchor, for each window
    count = n - size + 1
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    inside = text[:count] == text[size - 1 :]
    fresh = np.ones(count, bool)
    fresh[1:] = (place[1:] != place[:-1]) | (text[1:count] != text[: count - 1])
    first = np.flatnonzero(fresh & inside)
    stop = np.flatnonzero(fresh | ~inside)
    after = np.append(stop, count)[np.searchsorted(stop, first, side="right")]
    length = after - first + size - 1
    power, inverse = _powers(max(1 << (grams.bit_length()), 1))
    sums = np.zeros(grams + 1, np.uint64)
    np.cumsum(h * power[:grams], out=sums[1:])
    content = mix((sums[first + length - GRAM + 1] - sums[first]) * inverse[first]) + length.astype(np.uint64)
    of = text[first]
    begin = (ends - np.diff(ends, prepend=0))[of]
    return {"text": of, "start": first - begin, "place": place[first] - begin, "length": length, "anchor": h[place[first]], "content": content}


def grouped(texts: list[bytes], limit: int = GROUP_BYTES) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Texts laid end to end in groups that stay in the cache: the first one's index, bytes, ends."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= limit):
            size += len(texts[stop])
            stop += 1
        part = texts[at:stop]
        yield at, b"".join(part), np.cumsum([len(t) for t in part])
        at = stop
