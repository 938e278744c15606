"""Counting quotient filters against plain counting, and phrases against brute force."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from tablesmith.llm import phrases, quotient


@pytest.mark.parametrize("half", [1, 5, 17, 31, 32, 33, 50, 64])
def test_filter_is_lossless(half):
    rng = np.random.default_rng(half)
    top = min((1 << half) - 1, (1 << 63) - 1)
    keys = [rng.integers(0, top, 3000, np.uint64, endpoint=True) for _ in range(2)]
    back = quotient.restore(quotient.permute(tuple(keys), half), half)
    assert all((a == b).all() for a, b in zip(keys, back))
    want = Counter()
    filters = []
    for part in range(4):
        at = rng.integers(0, 8 if part else 3000, 2500)
        own = tuple(k[at] for k in keys)
        want.update(zip(own[0].tolist(), own[1].tolist()))
        packed = quotient.pack(*quotient.count(own, half), half)
        filters.append(quotient.unpack(packed))
        assert quotient.pack(*filters[-1], half) == packed
    merged, counts = quotient.merge(filters, half)
    got = dict(zip(zip(*(k.tolist() for k in quotient.restore(merged, half))), counts.tolist()))
    assert got == dict(want)
    assert max(counts) > 255
    for bits in range(0, min(half, 4) + 1):
        stops = quotient.shards(merged, half, bits)
        assert stops[-1] == len(counts)
        assert ((merged[0][stops[0] :] >> np.uint64(half - bits)) > 0).all() if bits else True


def test_equal_upper_bits_are_told_apart():
    left = np.array([5, 5, 5, 5], np.uint64)
    right = np.array([7, 3, 7, 3], np.uint64)
    (a, b), n = quotient._summed((left, right), np.ones(4, np.int64), 60)
    assert (a.tolist(), b.tolist(), n.tolist()) == ([5, 5], [3, 7], [2, 2])


def test_filter_of_nothing():
    none = np.zeros(0, np.uint64)
    keys, counts = quotient.unpack(quotient.pack(*quotient.count((none, none), 40), 40))
    assert len(counts) == len(keys[0]) == 0


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    for bits in (1, 3, 13, 17, 20, 25):
        for size in (2, 3, 4, 5):
            ids = rng.integers(1, 1 << bits, 300).astype(np.uint32)
            at = np.arange(290)
            keys = phrases._packed(ids, size, at, bits)
            assert (phrases._unpacked(keys, size, bits) == np.stack([ids[at + j] for j in range(size)], 1)).all()


def brute(rows, min_count, max_words, top, contained):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if c.isascii() else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            for size in range(1, max_words + 1):
                f.setdefault(lang, Counter()).update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = set()
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        left = []
        for p, a in good.items():
            inside = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))  # noqa: B023, E731
            if any(inside(q) and 100 * b >= contained * a for q, b in good.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            left.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(left)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return out


def corpus():
    rnd = random.Random(9)
    vocabulary = ["é", "Z", "Ä", "the", "a\x1cb", "x-y", "\x00", "🙂", *[f"w{i}" for i in range(25)]]
    rows = []
    for i in range(300):
        words = [rnd.choice(vocabulary[: rnd.choice([4, 12, 33])]) for _ in range(rnd.randint(0, 40))]
        if i % 3:
            words[rnd.randint(0, len(words)) : 0] = "kept all together NOW".split()
        text = ""
        for w in words:
            text += w + rnd.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "!", "\r\n"])
        rows.append((rnd.choice(["en", "en", "fr", None, "und"]), text))
    return rows + [("en", None), ("de", "no frequent word here"), (None, ""), rows[3], rows[3], ("en", "loop " * 700)]


@pytest.mark.parametrize("dictionary", [1 << 19, 0])
@pytest.mark.parametrize("min_count, max_words, top, contained", [(20, 5, 2000, 100), (3, 3, 40, 60), (8, 2, 5, 100), (5, 7, 300, 90)])
def test_phrases(spark, dictionary, min_count, max_words, top, contained):
    if dictionary == 0 and min_count != 20:
        pytest.skip("one setting is enough for the join")
    docs = spark.createDataFrame(corpus(), "lang string, text string").selectExpr("*", "1 AS n", "'x' AS word", "2 AS ids")
    got = phrases.collocations(docs, min_count, max_words, top, contained, dictionary=dictionary).collect()
    assert {tuple(r) for r in got} == brute(corpus(), min_count, max_words, top, contained)
    assert len(got) == len(set(got)) > 4


def test_tasks_that_hold_little_pass_filters_on(spark, monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 64)
    monkeypatch.setattr(phrases, "SHARD_KEYS", 32)
    docs = spark.createDataFrame(corpus(), "lang string, text string")
    assert {tuple(r) for r in phrases.collocations(docs, 5).collect()} == brute(corpus(), 5, 5, 2000, 100)


def test_products_beyond_64_bits(spark):
    found = spark.createDataFrame([([1, 2], 3_000_000_000_000)], "ids array<long>, a long")
    vocabulary = spark.createDataFrame([("en", "big", 4_000_000_000_000, 1), ("en", "words", 3_000_000_000_000, 2)], "lang string, word string, n long, id long")
    total = spark.createDataFrame([("en", 9_000_000_000_000_000)], "lang string, total long")
    (row,) = phrases._ranked(found, vocabulary, total, 10, 100, lambda df, _: df).collect()
    assert row.score == 1000 * 3_000_000_000_000 * 9_000_000_000_000_000 // (4_000_000_000_000 * 3_000_000_000_000)


def test_small_tables(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", "just once")], "lang string, text string")).count() == 0
    with pytest.raises(ValueError):
        phrases.collocations(empty, 0)


def test_a_counting_task_holds_few_keys():
    """Runs of words that never repeat: the task passes keys on instead of keeping them, and reads texts without a second worker."""

    class Corpus:
        def mapInArrow(self, work, _):  # noqa: N802
            self.work = getattr(self, "work", work)  # the first is the one that counts
            return self

        def repartition(self, *_):
            return self

        sortWithinPartitions = repartition  # noqa: N815

    rnd, corpus = np.random.default_rng(3), Corpus()
    phrases.frequent_phrases(corpus, lambda _: (rnd.integers(1, 1 << 15, 1 << 18).astype(np.uint32) for _ in range(16)), range(3, 6), 15, 2, 4)
    tracemalloc.start()
    keys = sum(quotient._HEAD.unpack_from(batch.column(2)[0].as_py())[0] for batch in corpus.work(iter([])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert keys > 12_000_000 and peak < 160 << 20
