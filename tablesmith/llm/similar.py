"""Near duplicates by the Jaccard similarity of word shingle sets, exact at any size.

The shingles of all sets are put into one order. Two sets of similarity t at least share one of the
first n - ceil(t n) + 1 shingles of either, so only documents that meet under such a shingle are
candidates, and every candidate that sizes and places don't rule out is compared set by set. Any one
order finds all pairs; here it is by how many documents of a sample share a shingle, the rarest first,
and then by hash, so that boilerplate hardly ever is among the first ones of a set that has more than it.

Only which documents are connected matters: a first round compares documents whose SimHash fingerprints
of the same shingles are linked in BK-trees, and each document with one other under its few shingles of
least hash; the second skips pairs that are connected by then, so a group of near copies costs about one
row a member and shingle. Fingerprints propose pairs, the sets decide, and the second round finds what
fingerprints miss: pairs of similarity 0.8 mostly differ in more bits than the trees' radius.

Texts are what is heavy, so few of them are shuffled: a bit sketch of either set rules most candidates out
before their texts are fetched, and Bloom filters of row keys leave all others where they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.bpe import by_bytes
from tablesmith.llm.common import least_row, row_key, text_of
from tablesmith.llm.components import connected_components
from tablesmith.llm.decontam import bloom_filter, in_bloom
from tablesmith.llm.simhash import fingerprint_links, majority
from tablesmith.llm.words import hash_words, mix, windows
from tablesmith.session import scratch_tables, stored

WIDTH = 5
SIMILARITY = 0.8
SAMPLED = 16  # one text in so many says which shingles are common
GROUP_CHARS = 1 << 20
_FIRST = 8  # shingles under which the first round looks
_HELD = 64  # sets a task remembers
_ODD_BITS = 1024  # bits of a sketch
_SLACK = 1e-9  # for products of the similarity that should be whole


def shingle_sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text is one shingle, one without words has none."""
    words, bounds = hash_words([t.encode().lower() for t in texts])
    hashes, at = windows(words, bounds, width)
    cuts = np.searchsorted(at, bounds)
    out = []
    for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
        if 0 < b - a < width:
            short, _ = windows(words[a:b], np.array([0, b - a]), b - a)
            out.append(mix(short + np.uint64(b - a)))
        else:
            out.append(np.unique(hashes[cuts[i] : cuts[i + 1]]))
    return out


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """Bits that say which of so many buckets hold an odd number of shingles, as 64-bit integers.

    Each bit in which two sketches differ stands for a shingle at least that only one of the sets has.
    """
    odd = np.bincount((shingles % np.uint64(_ODD_BITS)).astype(np.int64), minlength=_ODD_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _may_hold(keys: DataFrame, seed: Column) -> Column:
    """True for each ``seed`` that ``keys`` (``seed``) holds, and for hardly any other: a Bloom filter."""
    bloom = keys.sparkSession.sparkContext.broadcast(bloom_filter(keys, keys.count()))

    @F.pandas_udf("boolean")
    def held(seeds: pd.Series) -> pd.Series:
        return pd.Series(in_bloom(bloom.value, seeds.to_numpy().view(np.uint64)))

    return held(seed)


def _common_shingles(rows: DataFrame, width: int, keep) -> list[np.ndarray]:
    """Bloom filters of the shingles that 2, 4, 8 and so on different texts of a sample hold; ``rows`` has ``text``.

    They only order shingles: what they miss or hold by mistake costs time and loses nothing.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in by_bytes((x.as_py() for x in batch.column(0)), GROUP_CHARS):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(group, width)).view(np.int64))], names=["seed"])

    own = F.xxhash64("text")
    sample = rows.where(F.pmod(own, F.lit(SAMPLED)) == 0).groupBy(own).agg(F.first("text").alias("text")).select("text")
    common = sample.mapInArrow(work, "seed long").groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    common = keep(common.select("seed", F.floor(F.log2("n")).cast("int").alias("grade")), "common-shingles")
    sizes = {r["grade"]: r["count"] for r in common.groupBy("grade").count().collect()}  # one row for each power of two
    return [bloom_filter(common.where(F.col("grade") >= g), sum(n for k, n in sizes.items() if k >= g)) for g in range(1, max(sizes, default=0) + 1)]


def _grades(common: list[np.ndarray], shingles: np.ndarray) -> np.ndarray:
    """How common each shingle is: the number of filters in a row that hold it."""
    out, left = np.zeros(len(shingles), np.int8), np.arange(len(shingles))
    for bloom in common:
        left = left[in_bloom(bloom, shingles[left])]
        out[left] += 1
    return out


def _signed(docs: DataFrame, width: int, similarity: float, id_col: str, text_col: str, common: list[np.ndarray]) -> DataFrame:
    """``key``, ``doc_id``, ``node`` (128-bit hash of the set), ``n`` (its size), ``fp`` (its fingerprint), ``odd`` (its sketch), ``least`` (its least hashes) and ``prefix`` for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def lists(parts: list[np.ndarray]) -> pa.ListArray:
        return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(c) for c in parts]))).astype(np.int32), pa.array(np.concatenate(parts).view(np.int64)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for group in by_bytes((x.as_py() for x in batch.column(2)), GROUP_CHARS):
                sets = shingle_sets(group, width)
                grades = np.split(_grades(shared.value, np.concatenate(sets)), np.cumsum([len(s) for s in sets])[:-1])
                prefix = []
                for s, g in zip(sets, grades):
                    n = len(s) - math.ceil(similarity * len(s) - _SLACK) + 1
                    prefix.append(s[np.argsort(g, kind="stable")[:n]])
                node = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                size = pa.array([len(s) for s in sets], pa.int32())
                prints = pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64))
                odd = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * (_ODD_BITS // 64), pa.array(np.concatenate([odd_sketch(s) for s in sets])))
                head = [batch.column(i).slice(at, len(group)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*head, node, size, prints, odd, lists([s[:_FIRST] for s in sets]), lists(prefix)], names=["key", "doc_id", "node", "n", "fp", "odd", "least", "prefix"])
                at += len(group)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(work, f"key struct<a:long,b:long>, doc_id {kind}, node binary, n int, fp long, odd array<long>, least array<long>, prefix array<long>")


def _shared_shingles(sets: DataFrame, keep) -> DataFrame:
    """``shingle``, ``id``, ``n``, ``at`` (place) of the shingles of ``prefix`` that several sets have there."""
    each = sets.select(F.explode("prefix").alias("seed"), "id")
    several = keep(each.groupBy("seed").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("seed"), "several")
    bloom = sets.sparkSession.sparkContext.broadcast(bloom_filter(several, several.count()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column(2)
            size = np.diff(prefix.offsets.to_numpy())
            values = prefix.flatten().to_numpy()
            hit = np.flatnonzero(in_bloom(bloom.value, values.view(np.uint64)))
            row = np.repeat(np.arange(len(size)), size)[hit]
            place = (hit - (np.cumsum(size) - size)[row]).astype(np.int32)
            cols = [pa.array(values[hit]), *(batch.column(i).take(pa.array(row)) for i in (0, 1)), pa.array(place)]
            yield pa.RecordBatch.from_arrays(cols, names=["seed", "id", "n", "at"])

    listed = sets.select("id", "n", "prefix").mapInArrow(work, "seed long, id long, n int, at int")
    return listed.join(several, "seed").withColumnRenamed("seed", "shingle")


def _not_apart(pairs: DataFrame, of_rows: DataFrame, similarity: float) -> DataFrame:
    """The pairs (``a``, ``b``) whose sketches leave the similarity possible: no pair that has it is lost."""
    sides = [of_rows.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("odd").alias(f"odd{s}")) for s in "ab"]
    differ = F.aggregate(F.zip_with("odda", "oddb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    most = (1 - similarity) / (1 + similarity) * (F.col("na") + F.col("nb")) + _SLACK
    return pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b").where(differ <= most).select("a", "b")


def _alike(pairs: DataFrame, of_rows: DataFrame, docs: DataFrame, width: int, similarity: float, keep) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets are as similar as that, each compared whole. ``docs`` has ``key`` and ``text``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}

        def of(i: int, text: pa.Scalar) -> np.ndarray:
            if i not in sets:
                if len(sets) >= _HELD:
                    sets.pop(next(iter(sets)))
                sets[i] = shingle_sets([text.as_py()], width)[0]
            return sets[i]

        for batch in batches:
            hit = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                own, other = of(a, x), of(b, y)
                both = len(np.intersect1d(own, other, assume_unique=True))
                hit.append(both >= similarity * (len(own) + len(other) - both) - _SLACK)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))

    pairs = keep(pairs.select("a", "b"), "candidates")
    wanted = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct()
    wanted = keep(of_rows.select("id", "key").join(wanted, "id"), "wanted")
    texts = docs.where(_may_hold(wanted.select(F.col("key.a").alias("seed")), F.col("key.a"))).groupBy("key").agg(F.first("text").alias("text"))
    texts = keep(texts.join(wanted, "key").select("id", "text"), "candidate-texts")
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def _near_prints(sets: DataFrame, keep) -> DataFrame:
    """Pairs (``a``, ``b``) of ids: sets of one fingerprint with the first of them, and the first ones of linked fingerprints."""
    first = keep(sets.groupBy("fp").agg(F.min("id").alias("a")), "fingerprints")
    links = fingerprint_links(first.select("fp"), keep=keep).distinct()
    of_a, of_b = first.select(F.col("fp").alias("a"), F.col("a").alias("x")), first.select(F.col("fp").alias("b"), F.col("a").alias("y"))
    linked = links.join(of_a, "a").join(of_b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return sets.join(first, "fp").where("a <> id").select("a", F.col("id").alias("b")).unionAll(linked)


def similar_groups(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key``, ``doc_id`` and ``root`` for each row: rows have one root exactly when similar pairs connect them.

    Shingles are ``width`` words, ASCII case folded, repeats counted once, and stand as 64-bit hashes;
    ``similarity`` (above 0) is that of their sets. All texts without words are alike. Repeated rows get equal answers.
    """
    with scratch_tables(docs.sparkSession) as keep:
        return stored(_groups(docs, width, similarity, id_col, text_col, keep), "similar")


def _groups(docs: DataFrame, width: int, similarity: float, id_col: str, text_col: str, keep) -> DataFrame:
    rows = docs.select(row_key(id_col, text_col).alias("key"), text_of(text_col).alias("text"))
    signed = _signed(docs, width, similarity, id_col, text_col, _common_shingles(rows, width, keep))
    of_rows = keep(signed.withColumn("id", F.monotonically_increasing_id()), "shingle-sets")
    nodes = keep(of_rows.groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows")), "distinct-sets")
    # sets of one row stay where they are
    repeated = _may_hold(nodes.where("rows > 1").select(F.xxhash64("node").alias("seed")), F.xxhash64("node"))
    sets = of_rows.where(~repeated).unionByName(of_rows.where(repeated).join(nodes.select("id"), "id", "left_semi"))

    # the first round may miss pairs, the second takes all that are not connected by then
    few = keep(sets.select("id", "n", F.explode("least").alias("shingle")), "least-shingles")
    lead = few.groupBy("shingle").agg(F.min("id").alias("a"))
    near = few.join(lead, "shingle").where("a <> id").groupBy("a", F.col("id").alias("b"), "n").agg(F.count(F.lit(1)).alias("c"))
    near = near.where(2 * F.col("c") >= F.least(F.lit(_FIRST), F.col("n")))
    near = _not_apart(near.select("a", "b").unionAll(_near_prints(sets, keep)).distinct(), of_rows, similarity)
    links = keep(_alike(near, of_rows, rows, width, similarity, keep), "first-links")

    shared = keep(_shared_shingles(sets.select("id", "n", "prefix"), keep), "shared-shingles")
    roots = connected_components(links).withColumnRenamed("node", "id")
    named = shared.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = named.groupBy("shingle").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("shingle")
    named = keep(named.join(mixed, "shingle"), "mixed-shingles")
    # similar sets share at least so many shingles, and all of those from their first common one on
    share = similarity / (1 + similarity)
    # of two groups at one shingle only those meet that may hold such sets
    kinds = named.groupBy("shingle", "root").agg(F.max(F.col("n") - F.col("at")).alias("far"), F.min("n").alias("n"))
    ka, kb = (kinds.select("shingle", F.col("root").alias(f"r{s}"), F.col("far").alias(f"far{s}"), F.col("n").alias(f"n{s}")) for s in "ab")
    apart = (F.col("ra") < F.col("rb")) & (F.least("fara", "farb") >= share * (F.col("na") + F.col("nb")) - _SLACK)
    kinds = ka.join(kb, "shingle").where(apart).select("shingle", "ra", "rb")
    sides = [named.select("shingle", F.col("root").alias(f"r{s}"), F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("at").alias(f"at{s}")) for s in "ab"]
    met = kinds.join(sides[0], ["shingle", "ra"]).join(sides[1], ["shingle", "rb"])
    least = share * (F.col("na") + F.col("nb")) - _SLACK
    beyond = F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb"))
    met = met.where(beyond >= least)
    met = met.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("c"), F.max("ata").alias("ata"), F.max("atb").alias("atb"))
    # up to the last common shingle that is left they share c, and after it at most what either has there
    met = _not_apart(met.where(F.col("c") + beyond - 1 >= least), of_rows, similarity)
    found = connected_components(links.unionAll(_alike(met, of_rows, rows, width, similarity, keep)))
    named = nodes.join(found.withColumnRenamed("node", "of"), F.col("id") == F.col("of"), "left").select("node", F.coalesce("root", "id").alias("root"))
    return of_rows.select("key", "doc_id", "node").join(named, "node").select("key", "doc_id", "root")


def drop_similar(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of ``similar_groups``, chosen as in ``one_of_each``; rows alone in theirs are not shuffled."""
    groups = similar_groups(docs, width, similarity, id_col, text_col)
    several = groups.groupBy("root").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("root")
    several = stored(groups.join(several, "root"), "of-several")
    best = several.groupBy("root").agg(least_row().alias("best"))
    gone = several.join(best, "root").where(F.col("key") != F.col("best.key")).select("key")
    rows = docs.select(F.struct("*").alias("row"), row_key(id_col, text_col).alias("key"))
    held = _may_hold(several.select(F.col("key.a").alias("seed")), F.col("key.a"))
    chosen = rows.where(held).join(gone, "key", "left_anti").groupBy("key").agg(F.first("row").alias("row"))
    return rows.where(~held).select("row.*").unionAll(chosen.select("row.*"))
