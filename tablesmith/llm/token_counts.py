"""Exact token counts at every prefix of a text, by dynamic programming.

In a byte-level BPE two tokens may follow each other exactly when encoding their joined bytes gives
just these two back, and a sequence is the encoding of its bytes exactly when all its neighbours
may. So the last token of a prefix is the one token that ends there and may follow the last token of
the shorter prefix before it; counts add up along the way. One pass over a piece stores the count at
each of its prefixes, and truncation and budgets are then looked up, never encoded again.
Pieces are taken in sorted order, so what neighbours share at their start is computed once.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.bpe import PieceCache, by_bytes
from tablesmith.llm.common import text_of
from tablesmith.llm.pretokens import BLANK, CONTRACTIONS, _classes, byte_offsets, code_points, piece_starts, pieces

MEMO_PAIRS = 500_000  # neighbour checks remembered by a task


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes in such vocabularies: themselves, or from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Merges:
    """The merges of a byte-level BPE file, and prefix tables made with them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = _byte_of_char()
        raw = lambda s: bytes(to_byte[c] for c in s)
        special = {t["content"] for t in spec["added_tokens"]}
        self.special = sorted(special, key=len, reverse=True)
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): r for r, (a, b) in enumerate(merges)}
        self.longest = max(map(len, self.ids))
        self.tokens = {i: t for t, i in self.ids.items()}
        self.memo: dict[int, bool] = {}
        self.cache = PieceCache(self.tables)

    def _encoded(self, data: bytes) -> list[bytes]:
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            low, i = min(((self.rank.get(p, len(self.rank)), i) for i, p in enumerate(zip(parts, parts[1:]))))
            if low == len(self.rank):
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def may_follow(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart side by side; left -1: whether merging reaches ``right`` at all."""
        b = self.tokens[right]
        if left < 0:
            return len(b) == 1 or self._encoded(b) == [b]
        a = self.tokens[left]
        return (a, b) not in self.rank and self._encoded(a + b) == [a, b]

    def tables(self, parts: list[bytes]) -> list[array]:
        """For each piece the token counts of its prefixes of 0, 1, 2 ... bytes."""
        out: list = [None] * len(parts)
        last, count = [-1], [0]
        previous = b""
        find, memo, longest = self.ids.get, self.memo, self.longest
        if len(memo) > MEMO_PAIRS:
            memo.clear()
        for k in sorted(range(len(parts)), key=parts.__getitem__):
            piece = parts[k]
            n, same = len(piece), 0
            for x, y in zip(piece, previous):
                if x != y:
                    break
                same += 1
            del last[same + 1 :], count[same + 1 :]
            for i in range(same + 1, n + 1):
                for j in range(i - 1, max(-1, i - longest - 1), -1):
                    token = find(piece[j:i])
                    if token is not None:
                        key = last[j] << 20 | token  # -1 stands for the start
                        known = memo.get(key)
                        if known is None:
                            known = memo[key] = self.may_follow(last[j], token)
                        if known:
                            break
                last.append(token)
                count.append(count[j] + 1)
            out[k] = array("I", count)
            previous = piece
        return out


@lru_cache(maxsize=2)
def load_merges(path: str) -> Merges:
    return Merges(path)


def split_special(merges: Merges, text: str) -> list[str]:
    """Ordinary text and special strings in turn, beginning and ending with ordinary text."""
    if not merges.special:
        return [text]
    return re.split("(" + "|".join(map(re.escape, merges.special)) + ")", text)


def _plain_counts(merges: Merges, text: str) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, 2 ... code points of a text without special strings."""
    cp = code_points(text)
    n = len(cp)
    out = np.zeros(n + 1, np.int64)
    if not n:
        return out
    blank = _classes()[cp] == BLANK
    offset = byte_offsets(cp)
    data = text.encode()

    def table(a: int, b: int) -> np.ndarray:
        part = data[offset[a] : offset[b]]
        return np.asarray(merges.cache.of({part})[part], np.int64)[offset[a : b + 1] - offset[a]]

    starts = piece_starts(cp).tolist()
    total = 0
    for a, b in zip(starts, [*starts[1:], n]):
        counts = table(a, b)
        out[a + 1 : b + 1] = total + counts[1:]
        if b - a == 3 and cp[a] == 0x27 and text[a + 1 : b] in CONTRACTIONS:
            out[a + 2] = out[a + 1] + table(a + 1, a + 2)[1]  # a cut contraction is a mark and a letter
        total += int(counts[-1])
    # a prefix that ends in blanks has them all in one piece
    ends = np.flatnonzero(blank & ~np.append(blank[1:], False)) + 1
    for b in ends.tolist():
        a = b - 1
        while a and blank[a - 1]:
            a -= 1
        out[a + 1 : b + 1] = out[a] + table(a, b)[1:]
    return out


def prefix_counts(merges: Merges, text: str) -> np.ndarray:
    """The exact token count of ``text[:i]`` for each i from 0 to its length."""
    parts = split_special(merges, text)
    out, base = [np.zeros(1, np.int64)], 0
    for plain, special in zip(parts[::2], [*parts[1::2], ""]):
        counts = _plain_counts(merges, plain + special[:-1])
        out.append(base + counts[1:])
        base += int(counts[len(plain)])
        if special:
            base += 1
            out.append(np.array([base]))
    return np.concatenate(out)


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """The most code points whose prefix has at most ``budget`` tokens."""
    return int(np.flatnonzero(counts <= budget)[-1])


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", with_prefix: bool = False) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit``, and with ``with_prefix`` the code points
    of the longest prefix within the limit (``fits_chars``) and the count at every prefix (``prefix_tokens``).

    Special strings count one token each. A null or empty text has none; every row gets a row.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = load_merges(path)
        for batch in batches:
            at = 0
            for group in by_bytes(x.as_py() for x in batch.column(1)):
                cols = [batch.column(0).slice(at, len(group)), pa.array([len(t.encode()) for t in group], pa.int64())]
                at += len(group)
                if with_prefix:
                    tables = [prefix_counts(merges, t) for t in group]
                    cols += [pa.array([int(x[-1]) for x in tables], pa.int64()), pa.array([bool(x[-1] > limit) for x in tables])]
                    cols += [pa.array([longest_prefix(x, limit) for x in tables], pa.int64()), pa.array([x.tolist() for x in tables], pa.list_(pa.int64()))]
                else:
                    totals = _totals(merges, group)
                    cols += [pa.array(totals, pa.int64()), pa.array([n > limit for n in totals])]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["doc_id", "n_bytes", "n_tokens", "over_limit", *(["fits_chars", "prefix_tokens"] if with_prefix else [])]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean" + (", fits_chars long, prefix_tokens array<long>" if with_prefix else "")
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(work, schema)


def _totals(merges: Merges, texts: list[str]) -> list[int]:
    """The last entries of the texts' prefix tables: those of their pieces, added up."""
    split, specials = [], []
    for t in texts:
        parts = split_special(merges, t)
        split.append([p for plain in parts[::2] for p in pieces(plain)])
        specials.append(len(parts) // 2)
    known = {p: table[-1] for p, table in merges.cache.of(set().union(*split)).items()} if split else {}
    return [sum(map(known.__getitem__, p)) + s for p, s in zip(split, specials)]
