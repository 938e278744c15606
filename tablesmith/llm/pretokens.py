"""Splitting a text into the pieces that byte-level BPE merges apart from each other.

The pattern of the byte-level rank files, as array operations on the text's code points: runs of
letters, numbers or other marks with one space before them, runs of blanks less the last one before
a word, and the English contractions.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

BLANK, LETTER, NUMBER, MARK = 0, 1, 2, 3
# The code points with the White_Space property.
WHITE_SPACE = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A,
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
# The contractions the pattern names, after their apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@cache
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], MARK) for c in range(0x110000)), np.uint8, 0x110000)
    table[list(WHITE_SPACE)] = BLANK
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def byte_offsets(cp: np.ndarray) -> np.ndarray:
    """Where each code point begins in UTF-8, and the whole length."""
    out = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000), out=out[1:])
    return out


def piece_starts(cp: np.ndarray) -> np.ndarray:
    """Indexes of the code points that begin a piece."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    cls = _classes()[cp]
    start = np.ones(n, bool)
    start[1:] = cls[1:] != cls[:-1]
    last = np.flatnonzero((cls[:-1] == BLANK) & (cls[1:] != BLANK))  # the blank before a word stands alone or joins it
    start[last] = True
    start[last[cp[last] == 0x20] + 1] = False
    quote = np.flatnonzero(cp[:-1] == 0x27)
    quote = quote[start[quote]]
    if len(quote):
        ends = np.append(cp, np.zeros(2, cp.dtype))
        a, b = ends[quote + 1], ends[quote + 2]
        for letters in CONTRACTIONS:
            hit = a == ord(letters[0])
            if len(letters) == 2:
                hit &= b == ord(letters[1])
            at = quote[hit]
            start[at + 1] = False
            after = at + 1 + len(letters)
            start[after[after < n]] = True
    return np.flatnonzero(start)


def pieces(text: str) -> list[bytes]:
    """The pieces of ``text`` in order, as UTF-8."""
    data = text.encode()
    if len(data) == len(text):
        at = piece_starts(np.frombuffer(data, np.uint8))
    else:
        cp = code_points(text)
        at = byte_offsets(cp)[piece_starts(cp)]
    bounds = at.tolist()
    bounds.append(len(data))
    return [data[a:b] for a, b in zip(bounds, bounds[1:])]
