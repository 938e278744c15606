"""Byte-level BPE encoding and decoding by a bitmap queue of merge ranks.

Pieces become linked lists of tokens. For each merge rank a bucket holds the list positions whose
pair merges at that rank; a bitmap of three levels finds the next rank with a bucket by
find-first-set. Positions whose pair has changed meanwhile are stale and skipped. Work is linear in
the piece for each rank that occurs, so a piece may be very long.

Many pieces share one queue: pieces never merge across their ends, and the lowest rank of all is the
lowest of every piece that holds it, so a bucket is worked off in one go with array operations.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import text_of
from tablesmith.llm.pretokens import pieces

NO_RANK = np.iinfo(np.int64).max
CACHE_PIECES = 150_000  # encoded pieces remembered by a task, twice at most
BATCH_PIECES = 60_000  # new pieces that share a queue
BATCH_BYTES = 4 << 20  # text taken at once


class Ranks:
    """A vocabulary whose token ids are merge ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NO_RANK) if len(self.keys) else np.full(len(key), NO_RANK)


@lru_cache(maxsize=4)
def load_ranks(path: str) -> Ranks:
    """Read a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return Ranks({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)})


class RankQueue:
    """Buckets of positions by rank, with a bitmap of three levels of 64-bit words."""

    def __init__(self, size: int):
        self.low = [0] * (size // 64 + 1)
        self.mid = [0] * (size // 4096 + 1)
        self.top = 0
        self.buckets: dict[int, list] = {}

    def push(self, rank: int, positions) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [positions]
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
            self.top |= 1 << (rank >> 12)
        else:
            bucket.append(positions)

    def pop(self) -> tuple[int, list] | None:
        """The lowest rank and all its positions."""
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        b = a << 6 | (self.mid[a] & -self.mid[a]).bit_length() - 1
        rank = b << 6 | (self.low[b] & -self.low[b]).bit_length() - 1
        self.low[b] &= self.low[b] - 1
        if not self.low[b]:
            self.mid[a] &= self.mid[a] - 1
            if not self.mid[a]:
                self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


def encode_pieces(vocab: Ranks, parts: list[bytes]) -> list[np.ndarray]:
    """The token ids of each piece."""
    if not parts:
        return []
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    n = len(data)
    token = vocab.of_byte[data]
    following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    last = ends[ends > 0] - 1
    following[last] = n
    before[ends[(ends < n)]] = -1
    if n:
        before[0] = -1
    rank_at = np.full(n + 1, NO_RANK)
    inner = np.flatnonzero(following < n)
    rank_at[inner] = vocab.pair_ranks(token[inner], token[inner + 1])
    alive = np.ones(n, bool)
    queue = RankQueue(len(vocab.tokens))
    doubtful: set[int] = set()

    def push(at: np.ndarray) -> None:
        at = at[rank_at[at] != NO_RANK]
        if len(at) == 1:
            queue.push(int(rank_at[at[0]]), at)
        elif len(at):
            order = np.argsort(rank_at[at], kind="stable")
            at = at[order]
            ranks = rank_at[at]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(at)]
            for a, b, r in zip(bounds, bounds[1:], ranks[[0, *cuts]].tolist()):
                queue.push(r, at[a:b])

    push(inner)
    while (found := queue.pop()) is not None:
        rank, bucket = found
        at = bucket[0] if len(bucket) == 1 else np.unique(np.concatenate(bucket))
        at = at[rank_at[at] == rank]  # the others are stale
        if not len(at):
            continue
        if len(at) > 1:  # of pairs that overlap (aaa), every other one from the left
            at.sort()
            chained = following[at[:-1]] == at[1:]
            if chained.any():
                index = np.arange(len(at))
                first = np.maximum.accumulate(np.where(np.concatenate(([True], ~chained)), index, 0))
                at = at[(index - first) % 2 == 0]
        gone = following[at]
        after = following[gone]
        inside = after < n
        if len(at) > 1:
            # a pair that would only exist between two merges of this round must not come first
            early = vocab.pair_ranks(np.full(int(inside.sum()), rank), token[after[inside]]) < rank
            doubtful.update(at[inside][early].tolist())
        token[at] = rank
        alive[gone] = False
        rank_at[gone] = NO_RANK
        following[at] = after
        before[after[inside]] = at[inside]
        rank_at[at] = NO_RANK
        right = at[inside]
        rank_at[right] = vocab.pair_ranks(token[right], token[following[right]])
        left = before[at]
        left = left[left >= 0]
        rank_at[left] = vocab.pair_ranks(token[left], token[following[left]])
        changed = np.concatenate((right, left)) if len(left) else right
        if len(at) > 1:
            doubtful.update(changed[rank_at[changed] < rank].tolist())
            changed = np.unique(changed)
        push(changed)
    kept = np.flatnonzero(alive)
    out = np.split(token[kept], np.searchsorted(kept, ends)[:-1])
    if doubtful and len(parts) > 1:  # only in a vocabulary not made by merging: those pieces alone
        for i in np.unique(np.searchsorted(ends, sorted(doubtful), side="right")).tolist():
            out[i] = np.array(_one_by_one(vocab, parts[i]), np.int64)
    elif doubtful:
        out = [np.array(_one_by_one(vocab, parts[0]), np.int64)]
    return [np.array([vocab.ranks[p]]) if p in vocab.ranks else ids for p, ids in zip(parts, out)]


def _one_by_one(vocab: Ranks, part: bytes) -> list[int]:
    """The same, merging strictly one pair at a time, leftmost first."""
    token = vocab.of_byte[np.frombuffer(part, np.uint8)].tolist()
    while len(token) > 1:
        ranks = [vocab.ranks.get(vocab.tokens[a] + vocab.tokens[b], NO_RANK) for a, b in zip(token, token[1:])]
        low = min(ranks)
        if low == NO_RANK:
            break
        i = ranks.index(low)
        token[i : i + 2] = [low]
    return token


class PieceCache:
    """Results of pieces, in two generations: when the younger is full it replaces the older."""

    def __init__(self, make, size: int = CACHE_PIECES):
        self.make, self.size = make, size
        self.young: dict[bytes, object] = {}
        self.old: dict[bytes, object] = {}

    def of(self, parts: set[bytes]) -> dict[bytes, object]:
        """Results for a set of pieces; the new ones are made together."""
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young
        known, missing = {}, []
        for p in parts:
            hit = self.young.get(p)
            if hit is None:
                hit = self.old.get(p)
                if hit is not None:
                    self.young[p] = hit
            if hit is None:
                missing.append(p)
            else:
                known[p] = hit
        for i in range(0, len(missing), BATCH_PIECES):
            part = missing[i : i + BATCH_PIECES]
            made = dict(zip(part, self.make(part)))
            known.update(made)
            self.young.update((p, r) for p, r in made.items() if len(p) <= 64)
        return known


class Encoder:
    """Encodes texts as a rank file's library does for ordinary text, and decodes ids."""

    def __init__(self, vocab: Ranks):
        self.vocab = vocab
        self.cache = PieceCache(lambda parts: [ids.astype("<u4").tobytes() for ids in encode_pieces(vocab, parts)])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, for each text."""
        split = [pieces(t) for t in texts]
        known = self.cache.of(set().union(*split)) if split else {}
        return [b"".join(map(known.__getitem__, p)) for p in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(load_ranks(path))


def by_bytes(texts: Iterable[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Texts in groups of bounded size; a longer text is a group of its own."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > limit:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (unless ``with_ids`` is off), ``ids_sha256``, ``decoded_sha256``.

    ``path`` names the rank file on every executor. ``ids`` are binary, four little-endian bytes a
    token; the second hash is of the bytes they decode to. A null or empty text has no tokens. Every
    row gets a row, null ids and repeats too; there is no shuffle.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            at = 0
            for group in by_bytes(x.as_py() for x in batch.column(1)):
                ids = enc.encode_all(group)
                cols = [
                    batch.column(0).slice(at, len(group)),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    *([pa.array(ids, pa.binary())] if with_ids else []),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(enc.decode(x)).hexdigest() for x in ids], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=names)
                at += len(group)

    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_tokens", *(["ids"] if with_ids else []), "ids_sha256", "decoded_sha256"]
    schema = f"doc_id {kind}, n_tokens long, {'ids binary, ' if with_ids else ''}ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(work, schema)
