"""Benchmark decontamination by greedy string tiling.

Runs of a few tokens that a document shares with a benchmark item are seeds. Candidate pairs come
from a join on seeds, after a Bloom filter of the benchmark's seeds has kept those of other documents
from being shuffled. A pair whose seeds cover too little of the item cannot reach the threshold. For
the others, tiles are marked greedily: the longest matches not yet covered on either side first, each
round finding them by Karp-Rabin hashes, until only matches below the least length are left. Tiles may
lie in any order, so a passage with its sentences rearranged is covered like the original.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.binding import let
from tablesmith.llm.common import hash128, keep, row_key, text_of
from tablesmith.llm.bpe import by_bytes
from tablesmith.llm.words import hash_words, windows, word_bytes

MIN_MATCH = 4  # tokens of a seed, and of the shortest tile
COVERAGE = 0.5  # share of an item's tokens that tiles must cover
FIRST_LENGTH = 20  # matches are first sought at this length
GROUP_CHARS = 1 << 20  # text whose words are hashed at once; arrays take some forty bytes a character
BLOOM_BITS_LOG2 = (16, 27)  # least and largest Bloom filter, the largest being 16 MB
_BASE, _PRIME = 1_000_003, (1 << 61) - 1


def tokens(text: str) -> list[bytes]:
    """Runs of letters and digits in lower case; punctuation only separates."""
    data = text.lower().encode()
    inside = word_bytes(True)[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False)).tolist()
    return [data[a:b] for a, b in zip(edge[::2], edge[1::2])]


def _karp_rabin(values: list[int], free: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """Position and rolling hash of each run of ``length`` unmarked tokens."""
    top = pow(_BASE, length, _PRIME)
    value, run = 0, 0
    for i, (v, ok) in enumerate(zip(values, free)):
        if not ok:
            value, run = 0, 0
            continue
        value = (value * _BASE + v) % _PRIME
        run += 1
        if run > length:
            value = (value - values[i - length] * top) % _PRIME
        if run >= length:
            yield i - length + 1, value


def tile(item: list[bytes], doc: list[bytes], min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in document, length) of each tile.

    Longer tiles come first; among equals the one earlier in the document, then in the item.
    """
    least = min(min_match, len(item))
    if not least or len(doc) < least:
        return []
    a, b = [hash(t) & (1 << 60) - 1 for t in item], [hash(t) & (1 << 60) - 1 for t in doc]
    free_a, free_b = [True] * len(a), [True] * len(b)
    tiles: list[tuple[int, int, int]] = []
    length = max(least, min(FIRST_LENGTH, len(item)))
    while True:
        starts: dict[int, list[int]] = {}
        for i, h in _karp_rabin(a, free_a, length):
            starts.setdefault(h, []).append(i)
        matches, longest = [], 0
        for j, h in _karp_rabin(b, free_b, length) if starts else ():
            for i in starts.get(h, ()):
                # a match that also begins one token earlier was already found there
                if i and j and free_a[i - 1] and free_b[j - 1] and item[i - 1] == doc[j - 1]:
                    continue
                n = 0
                while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                if n >= length:
                    matches.append((-n, j, i))
                    longest = max(longest, n)
        if longest > 2 * length:  # look for the very long ones first
            length = longest
            continue
        for n, j, i in sorted(matches):
            if all(free_a[i : i - n]) and all(free_b[j : j - n]):
                free_a[i : i - n] = free_b[j : j - n] = [False] * -n
                tiles.append((i, j, -n))
        # what an overlap has cut may still hold a match of this length
        if not any(True for n, j, i in matches if _left(free_a, i, -n, length) and _left(free_b, j, -n, length)):
            if length == least:
                return tiles
            length = max(least, length // 2 if length > 2 * least else least)


def _left(free: list[bool], start: int, n: int, length: int) -> bool:
    """Whether ``length`` unmarked tokens in a row are left of a match."""
    run = 0
    for ok in free[start : start + n]:
        run = run + 1 if ok else 0
        if run >= length:
            return True
    return False


def _seed_rows(table: DataFrame, key: str, lengths: list[int], bloom: np.ndarray | None, places: bool) -> DataFrame:
    """Seeds of ``table`` (``key``, ``text``): all with their places, or distinct ones a Bloom filter lets through."""
    sc = table.sparkSession.sparkContext
    shared = None if bloom is None else sc.broadcast(bloom)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for group in by_bytes((x.as_py() for x in batch.column(1)), GROUP_CHARS):
                words, bounds = hash_words([t.lower().encode() for t in group], letters_only=True)
                of_text = np.repeat(np.arange(len(group)), np.diff(bounds))
                for size in lengths:
                    seeds, first = windows(words, bounds, size)
                    if shared is not None:
                        hit = np.flatnonzero(in_bloom(shared.value, seeds))
                        seeds, first = seeds[hit], first[hit]
                    row = of_text[first]
                    if not places:
                        pair = np.unique(np.stack([row.astype(np.uint64), seeds]), axis=1)
                        row, seeds = pair[0].astype(np.int64), pair[1]
                    cols = [batch.column(0).take(pa.array(row + at)), pa.array(seeds.view(np.int64))]
                    if places:
                        cols += [pa.array(first - bounds[row], pa.int64()), pa.array(np.full(len(seeds), size), pa.int64()), pa.array(np.diff(bounds)[row], pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, names=names)
                at += len(group)

    names = [key, "seed", *(["pos", "size", "n"] if places else [])]
    kind = table.schema[key].dataType.simpleString()
    return table.select(key, "text").mapInArrow(work, f"{key} {kind}, seed long" + (", pos long, size long, n long" if places else ""))


def _bits(seeds, log2: int):
    """The two bit numbers of a seed."""
    low = (1 << log2) - 1
    return seeds & np.uint64(low), (seeds >> np.uint64(32)) & np.uint64(low)


def in_bloom(words: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    log2 = len(words).bit_length() - 1 + 6
    found = np.ones(len(seeds), bool)
    for bit in _bits(seeds, log2):
        found &= (words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
    return found


def bloom_filter(seeds: DataFrame, n: int) -> np.ndarray:
    """64-bit words of a Bloom filter of ``n`` seeds: 16 bits a seed, within ``BLOOM_BITS_LOG2``.

    Bits are gathered by word in Spark, so the driver reads at most 2**21 words however many seeds.
    """
    log2 = min(max((16 * n).bit_length(), BLOOM_BITS_LOG2[0]), BLOOM_BITS_LOG2[1])
    low = (1 << log2) - 1
    bit = F.explode(F.array(F.col("seed").bitwiseAND(low), F.shiftrightunsigned("seed", 32).bitwiseAND(low)))
    place = seeds.select(bit.alias("bit")).select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, CAST(bit & 63 AS INT))").alias("m"))
    filled = place.groupBy("word").agg(F.bit_or("m").alias("m")).toArrow()
    words = np.zeros(1 << (log2 - 6), np.uint64)
    words[filled.column("word").to_numpy()] = filled.column("m").to_numpy().view(np.uint64)
    return words


def _cover(places: Column) -> Column:
    """Tokens that seeds (``pos``, ``size``) cover, from their sorted set."""
    step = lambda s: F.transform(s, lambda x, i: F.least(x["size"], F.coalesce(F.get(s, i + 1)["pos"] - x["pos"], x["size"])))
    return let(places, lambda s: F.aggregate(step(s), F.lit(0).cast("long"), lambda a, x: a + x))


def tilings(
    docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The contaminated pairs: ``key`` (of the document row), ``doc_id``, ``item_id``, ``item_tokens``,
    ``covered_tokens``, ``n_tiles``, ``longest_tile``, ``coverage`` and ``tiles`` (start in item, start in document, length).

    A pair is contaminated when tiles of at least ``min_match`` tokens cover at least ``coverage`` of
    the item's tokens. An item with fewer tokens must occur whole; one without tokens never matches,
    nor does an empty or null text. Rows repeated in full, in either table, are one and give one pair;
    equal items with several ids give one pair each. Null ids are kept.
    """
    item_kind, doc_kind = benchmark.schema[item_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    named = benchmark.select(F.col(item_col).alias("item_id"), text_of(item_text_col).alias("text")).distinct()
    named = named.withColumn("item", hash128(F.lower("text")))
    items = named.groupBy("item").agg(F.min("text").alias("text"))
    lengths = list(range(1, min_match + 1))
    seeds = _seed_rows(items, "item", lengths, None, True).where(F.col("size") == F.least(F.col("n"), F.lit(min_match)))
    seeds = keep(seeds.groupBy("item", "seed", "size", "n").agg(F.collect_set("pos").alias("places")), "seeds")
    facts = seeds.agg(F.count(F.lit(1)).alias("n"), F.collect_set("size").alias("sizes")).first()
    bloom = bloom_filter(seeds, facts["n"])

    rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    hits = _seed_rows(rows, "key", sorted(facts["sizes"]), bloom, False).join(seeds, "seed")
    places = F.transform("places", lambda p: F.struct(p.alias("pos"), F.col("size").alias("size")))
    pairs = hits.select("key", "item", "n", places.alias("places")).groupBy("key", "item").agg(F.first("n").alias("n"), F.collect_set("places").alias("places"))
    bound = _cover(F.sort_array(F.array_distinct(F.flatten("places"))))
    pairs = keep(pairs.select("key", "item", "n", bound.alias("bound")).where(F.col("bound") >= F.lit(coverage) * F.col("n")).select("key", "item"), "pairs")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, doc = None, []
        for batch in batches:
            out = []
            for k, (text, item) in enumerate(zip(batch.column(3), batch.column(4))):
                if text != last:
                    last, doc = text, tokens(text.as_py())
                goal = tokens(item.as_py())
                found = tile(goal, doc, min_match)
                covered = sum(n for _, _, n in found)
                if found and covered >= coverage * len(goal):
                    out.append((k, len(goal), covered, len(found), max(n for _, _, n in found), covered / len(goal), found))
            if out:
                at, *cols = zip(*out)
                kinds = [pa.int64()] * 4 + [pa.float64(), pa.list_(pa.list_(pa.int64()))]
                picked = [batch.column(i).take(pa.array(at)) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*picked, *(pa.array(c, t) for c, t in zip(cols, kinds))], names=names)

    names = ["key", "doc_id", "item", "item_tokens", "covered_tokens", "n_tiles", "longest_tile", "coverage", "tiles"]
    schema = (
        f"key struct<a:long,b:long>, doc_id {doc_kind}, item struct<a:long,b:long>, item_tokens long, covered_tokens long, "
        "n_tiles long, longest_tile long, coverage double, tiles array<array<long>>"
    )
    texts = rows.join(pairs, "key").join(items.withColumnRenamed("text", "item_text"), "item")
    tiled = texts.select("key", "doc_id", "item", "text", "item_text").mapInArrow(work, schema).dropDuplicates(["key", "item"])
    return tiled.join(named.select("item", "item_id"), "item").select("key", "doc_id", "item_id", *names[3:]).withColumn("item_id", F.col("item_id").cast(item_kind))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates; see ``tilings`` for what counts."""
    bad = keep(tilings(docs, benchmark, id_col=id_col, text_col=text_col, **options).select("key").distinct(), "contaminated")
    rows = docs.select(F.struct("*").alias("row"), row_key(id_col, text_col).alias("key"))
    return rows.join(bad, "key", "left_anti").select("row.*")
