"""Phrases that occur together more often than their parts would, counted in quotient filters.

Only words that occur often enough can be in a phrase that does, so those get dense ids and every
other word separates, like punctuation. An n-gram is its ids packed into one key; each task counts its
keys in counting quotient filters (see ``quotient``), cut into ranges of quotients, and the filters of
one range are merged, sorted as they are, in one place. Pairs are counted first: a longer phrase only
has to be counted where all its pairs are frequent, which a Bloom filter of bounded size tells without
missing any. Parts of a frequent phrase are frequent themselves, so all counts that scores need are there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.llm import quotient
from tablesmith.llm.bpe import by_bytes
from tablesmith.llm.decontam import bloom_filter, in_bloom
from tablesmith.llm.words import mix
from tablesmith.operators.ordering import add_row_id
from tablesmith.session import broadcast_if_small, scratch_tables, stored

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
CONTAINED = 100  # percent of its occurrences that a longer phrase takes for a phrase to be dropped
DICTIONARY = 1 << 19  # words sent to every task; a larger vocabulary is joined
GROUP_CHARS = 1 << 20
COUNTED = 1 << 18  # words that a task holds before it passes their counts on
HELD = 1 << 19  # keys of a size that a task holds before it passes its filters on
SHARD_KEYS = 1 << 20  # keys in a range of quotients, on average at most

# What ends a piece, and what separates words in it.
ENDS = ".,;:!?\n\x0b\x0c\r"
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes.maketrans(_UPPER + ENDS.encode() + b"\t", _LOWER + b"\n" * len(ENDS) + b" ")
_BREAK = b"."  # cannot be a word


def tokens(texts: list[str]) -> list[bytes]:
    """The lower-case words of all texts, with ``_BREAK`` between pieces and after each text."""
    return "\n".join([*texts, ""]).encode().translate(_TABLE).replace(b"\n", b" . ").split()


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    """The texts (column 1) of each language (column 0), in groups of bounded size."""
    langs = np.array(batch.column(0).to_pylist(), object)
    texts = np.array(batch.column(1).to_pylist(), object)
    for lang in dict.fromkeys(langs.tolist()):
        for group in by_bytes(texts[langs == lang], GROUP_CHARS):
            yield lang, group


def word_counts(rows: DataFrame) -> DataFrame:
    """``lang``, ``word``, ``n``: all occurrences; the empty word stands for all of its language."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            every = [(lang, w, n) for lang, c in held.items() for w, n in c.items()]
            held.clear()
            langs, words, n = zip(*every)
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([w.decode() for w in words], pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for lang, group in _by_lang(batch):
                counts = held.setdefault(lang, Counter())
                words = tokens(group)
                counts.update(words)
                counts[b""] += len(words) - counts.pop(_BREAK, 0)
                if sum(map(len, held.values())) > COUNTED:
                    yield out()
        if held:
            yield out()

    return rows.mapInArrow(work, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


Runs = Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]


def _ids_by_dictionary(rows: DataFrame, vocabulary: DataFrame) -> Runs:
    """What makes of the texts of ``rows`` runs of word ids, 0 between pieces and for other words, of many texts each.

    It runs in the worker that counts: a worker of its own would hold the dictionary and the texts beside.
    """
    table: dict[str, dict[bytes, int]] = {}
    for r in vocabulary.collect():  # at most DICTIONARY words
        table.setdefault(r.lang, {})[r.word.encode()] = r.id
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for lang, group in _by_lang(batch):
                known = shared.value.get(lang, {})
                words = tokens(group)
                yield np.fromiter(map(known.get, words, repeat(0)), np.uint32, len(words))

    return runs


def _stored_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The runs of a table made by ``_ids_by_join``."""
    for batch in batches:
        for blob in batch.column(0):
            yield np.frombuffer(blob.as_buffer(), np.uint32)


def _ids_by_join(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``ids``: the same runs for a vocabulary of any size, one row for each text."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = tokens([text])
                for a in range(0, len(words), HELD):
                    part = words[a : a + HELD]
                    cols = [pa.array([key] * len(part), pa.int64()), pa.array(range(a, a + len(part)), pa.int64()), pa.array([lang] * len(part)), pa.array([w.decode() for w in part])]
                    yield pa.RecordBatch.from_arrays(cols, names=["key", "pos", "lang", "word"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for places in batch.column(0):
                pairs = np.array([(p["pos"], p["id"]) for p in places.as_py()], np.int64)
                pairs = pairs[np.argsort(pairs[:, 0])]
                # what is missing between two places separates, however much it is
                at = np.cumsum(1 + (np.diff(pairs[:, 0], prepend=pairs[0, 0]) > 1)) - 1
                ids = np.zeros(at[-1] + 2, np.uint32)
                ids[at] = pairs[:, 1]
                out.append(ids.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    keyed = rows.select(F.monotonically_increasing_id().alias("key"), "lang", "text")
    words = keyed.mapInArrow(spread, "key long, pos long, lang string, word string").join(vocabulary, ["lang", "word"])
    return words.groupBy("key").agg(F.collect_list(F.struct("pos", "id")).alias("places")).select("places").mapInArrow(runs, "ids binary")


def _packed(ids: np.ndarray, size: int, at: np.ndarray, bits: int) -> quotient.Keys:
    """The ``size`` ids from each place as one key of two halves."""
    half = -(-size * bits // 2)
    low, high = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    mask = np.uint64((1 << half) - 1)
    for j in range(size):
        x, shift = ids[at + j].astype(np.uint64), j * bits
        if shift >= half:
            high |= x << np.uint64(shift - half)
        else:
            low |= (x << np.uint64(shift)) & mask
            if shift + bits > half:
                high |= x >> np.uint64(half - shift)
    return high, low


def _unpacked(keys: quotient.Keys, size: int, bits: int) -> np.ndarray:
    """The ids (one row for each key) that ``_packed`` took."""
    half = -(-size * bits // 2)
    high, low = keys
    out = np.zeros((len(high), size), np.int64)
    mask = np.uint64((1 << bits) - 1)
    for j in range(size):
        shift = j * bits
        if shift >= half:
            x = high >> np.uint64(shift - half)
        else:
            x = low >> np.uint64(shift)
            if shift + bits > half:
                x = x | high << np.uint64(half - shift)
        out[:, j] = (x & mask).astype(np.int64)
    return out


def _pair_seed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))


def frequent_phrases(corpus: DataFrame, runs: Runs, sizes: range, bits: int, min_count: int, shard_bits: int, bloom: np.ndarray | None = None) -> DataFrame:
    """``ids``, ``n``, ``seed`` (of pairs) of the phrases of these ``sizes`` that occur ``min_count`` times in the ``runs`` of ``corpus``."""
    shared = None if bloom is None else corpus.sparkSession.sparkContext.broadcast(bloom)
    half = {n: -(-n * bits // 2) for n in sizes}

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {n: [] for n in sizes}
        fresh = dict.fromkeys(sizes, 0)  # keys since the last merge

        def out(n: int) -> Iterator[pa.RecordBatch]:
            keys, counts = quotient.merge(held[n], half[n])
            held[n], fresh[n] = [], 0
            shift = min(shard_bits, half[n])
            stops = quotient.shards(keys, half[n], shift).tolist()
            for shard, (a, b) in enumerate(zip([0, *stops], stops)):
                if b > a:
                    blob = quotient.pack((keys[0][a:b], keys[1][a:b]), counts[a:b], half[n])
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([shard], pa.int32()), pa.array([blob], pa.binary())], names=["size", "shard", "filter"])

        for ids in runs(batches):
            good = (ids[:-1] > 0) & (ids[1:] > 0)
            if shared is not None:
                at = np.flatnonzero(good)
                good[at] = in_bloom(shared.value, _pair_seed(ids[at], ids[at + 1]))
            run = good
            for n in range(2, sizes.stop):
                if n > 2:  # all pairs of the n words
                    run = run[: max(len(run) - 1, 0)] & good[n - 2 :]
                at = np.flatnonzero(run) if n in half else ()
                for a in range(0, len(at), HELD):
                    held[n].append(quotient.count(_packed(ids, n, at[a : a + HELD], bits), half[n]))
                    fresh[n] += len(held[n][-1][1])
                    if fresh[n] > HELD:
                        held[n] = [quotient.merge(held[n], half[n])]
                        fresh[n] = 0
                        if len(held[n][0][1]) > HELD // 2:
                            yield from out(n)
        for n in sizes:
            if held[n]:
                yield from out(n)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def out() -> pa.RecordBatch:
            n = now[0]
            keys, counts = quotient.merge(held, half[n])
            often = counts >= min_count
            ids = _unpacked(quotient.restore((keys[0][often], keys[1][often]), half[n]), n, bits)
            rows = pa.ListArray.from_arrays(np.arange(len(ids) + 1, dtype=np.int32) * n, pa.array(ids.ravel()))
            seeds = _pair_seed(ids[:, 0], ids[:, 1]).view(np.int64)
            return pa.RecordBatch.from_arrays([rows, pa.array(counts[often]), pa.array(seeds)], names=["ids", "n", "seed"])

        for batch in batches:
            for n, shard, blob in zip(*batch.columns):
                key = (n.as_py(), shard.as_py())
                if now is not None and key != now:
                    yield out()
                    held, size = [], 0
                now = key
                held.append(quotient.unpack(blob.as_buffer()))
                size += len(held[-1][1])
                if size > 2 * SHARD_KEYS and len(held) > 1:  # copies of the same keys from many tasks
                    held = [quotient.merge(held, half[now[0]])]
                    size = 0
        if now is not None:
            yield out()

    dealt = corpus.mapInArrow(filters, "size int, shard int, filter binary").repartition("size", "shard").sortWithinPartitions("size", "shard")
    return dealt.mapInArrow(merged, "ids array<long>, n long, seed long")


def _exact(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, contained: int = CONTAINED,
    lang_col: str = "lang", text_col: str = "text", dictionary: int = DICTIONARY,
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the ``top`` phrases of each language.

    Words are in ASCII lower case; full stops, commas, colons, semicolons, question and exclamation
    marks and line breaks end a piece, and phrases never reach over such an end. ``a`` counts all
    occurrences of a phrase of 2 to ``max_words`` words, overlaps included, and must reach
    ``min_count``; ``n`` all words of the language. Of the cuts into a first part (``l`` occurrences)
    and a rest (``r``) the one of least ``floor(1000 a n / (l r))`` counts, ties to the shorter first
    part. Phrases inside a longer candidate that takes ``contained`` percent of their occurrences go.
    Order: score, then ``a``, descending, then the phrase by its UTF-8 bytes. Every row counts, repeated
    rows too; null languages are ``und``, null texts empty, and an empty table gives no rows. Counts are
    exact up to 33 million frequent words; sums and products are decimals of 38 digits.
    """
    if min_count < 1 or max_words < 2 or top < 1:
        raise ValueError("min_count and top are at least 1, max_words at least 2")
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with scratch_tables(docs.sparkSession) as keep:
        counts = keep(word_counts(rows).where((F.col("n") >= min_count) | (F.col("word") == "")), "words")
        vocabulary = keep(add_row_id(counts.where("word <> ''"), "id").withColumn("id", F.col("id") + 1), "vocabulary")
        total = counts.where("word = ''").select("lang", F.col("n").alias("total"))
        size, every = vocabulary.count(), total.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
        bits = max(size.bit_length(), 1)
        if max_words * bits > quotient.MAX_WIDTH:
            raise ValueError(f"{size} frequent words make phrases of over {quotient.MAX_WIDTH} bits; raise min_count")
        shard_bits = min((every // SHARD_KEYS).bit_length(), bits)
        names = vocabulary.select("lang", "word", "id")
        corpus, runs = (rows, _ids_by_dictionary(rows, names)) if size <= dictionary else (keep(_ids_by_join(rows, names), "word-ids"), _stored_runs)

        pairs = keep(frequent_phrases(corpus, runs, range(2, 3), bits, min_count, shard_bits), "pairs")
        found = pairs
        if max_words > 2:
            longer = frequent_phrases(corpus, runs, range(3, max_words + 1), bits, min_count, shard_bits, bloom_filter(pairs.select("seed"), pairs.count()))
            found = pairs.unionByName(keep(longer, "longer"))
        return stored(_ranked(found.select("ids", F.col("n").alias("a")), vocabulary, total, top, contained, keep), "phrases")


def _ranked(found: DataFrame, vocabulary: DataFrame, total: DataFrame, top: int, contained: int, keep) -> DataFrame:
    known = found.unionByName(vocabulary.select(F.array("id").alias("ids"), F.col("n").alias("a")))
    part = lambda name, own: broadcast_if_small(known.select(F.col("ids").alias(name), F.col("a").alias(own)))
    # a phrase that a longer one takes with it
    inside = F.expr("""flatten(transform(sequence(2, size(ids) - 1),
        w -> transform(sequence(1, size(ids) - w + 1), i -> slice(ids, i, w))))""")
    inner = found.where("size(ids) > 2").select(F.explode(inside).alias("ids"), F.col("a").alias("longer"))
    inner = inner.groupBy("ids").agg(F.max("longer").alias("longer"))
    open_ = found.join(inner, "ids", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < contained * F.col("a")))

    cuts = open_.select("ids", "a", F.explode(F.expr("sequence(1, size(ids) - 1)")).alias("k"))
    cuts = cuts.withColumns({"first": F.expr("slice(ids, 1, k)"), "rest": F.expr("slice(ids, k + 1, size(ids))"), "id": F.col("ids")[0]})
    cuts = cuts.join(part("first", "l"), "first").join(part("rest", "r"), "rest")
    langs = vocabulary.select("id", "lang").join(F.broadcast(total), "lang")  # one row for each language
    cuts = cuts.join(broadcast_if_small(langs), "id")
    score = F.expr("(CAST(1000 * a AS DECIMAL(19,0)) * CAST(total AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    best = cuts.groupBy("ids").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a", "lang", "total")).alias("b"))
    scored = keep(best.select("ids", "b.*"), "scored")

    words = scored.select("ids", F.posexplode("ids").alias("pos", "id")).join(broadcast_if_small(vocabulary.select("id", "word")), "id")
    spelled = words.groupBy("ids").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "word")))["word"], " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.join(spelled, "ids").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
