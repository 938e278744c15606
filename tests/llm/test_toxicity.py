"""Class models: proper chances, held-out accuracy on planted words, nothing learnt from held-out rows, awkward rows."""

import random
import zlib

import numpy as np
import pytest

from tablesmith.llm import toxicity


def test_chances_add_up():
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(10, 60, (900, 2)).astype(np.uint64), axis=0)
    counts = rng.integers(0, 40, (len(pairs), 2)).astype(float)
    model = toxicity.ClassModels.fit(pairs[:, 0], pairs[:, 1], counts)
    assert np.allclose(model.word_p[:-1].sum(axis=0), 1)
    table = {k: p for k, p in zip(model.pairs.tolist(), model.pair_p.tolist())}
    for v in range(len(model.words)):
        key = toxicity._pair_key(np.full(len(model.words), model.words[v]), model.words)
        seen = np.array([table.get(k, [0, 0]) for k in key.tolist()])
        assert np.allclose((seen + model.backoff[v] * model.word_p[:-1]).sum(axis=0), 1)


def slow_kneser_ney(rows):
    """P(w | v) of both classes from ``(v, w, ordinary, toxic)``, spelled out with dictionaries."""

    def discount(counts):
        once, twice = sum(c == 1 for c in counts), sum(c == 2 for c in counts)
        return min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.9)

    names = {v for v, *_ in rows} | {w for _, w, *_ in rows} | {1, 2}
    pairs = [{(v, w): n[k] for v, w, *n in rows if n[k]} for k in (0, 1)]
    both = {(v, w): sum(n) for v, w, *n in rows}
    before = lambda table: {x: len({v for v, w in table if w == x}) for x in names}
    spread = before(both)
    shared = {x: (spread[x] + 0.5) / (sum(spread.values()) + 0.5 * len(names)) for x in names}

    def level(table, v, w, lower):
        after = {b: n for (a, b), n in table.items() if a == v}
        if not after:
            return lower
        d = discount(list(table.values()))
        total = sum(after.values())
        taken = sum(max(n - d, 0) for n in after.values())
        return max(after.get(w, 0) - d, 0) / total + (1 - taken / total) * lower

    def chance(k, v, w):
        own = before(pairs[k])
        some = [n for n in own.values() if n]
        word = shared[w]
        if some:
            word = (max(own[w] - discount(some), 0) + discount(some) * len(some) * shared[w]) / sum(some)
        return level(pairs[k], v, w, level(both, v, w, word))

    return names, chance


@pytest.mark.parametrize("one_class", [False, True])
def test_chances_are_kneser_ney(one_class):
    rng = np.random.default_rng(2)
    pairs = np.unique(rng.integers(10, 25, (90, 2)).astype(np.uint64), axis=0)
    counts = rng.integers(0, 5, (len(pairs), 2)).astype(float)
    counts[:, 1] *= not one_class
    counts[counts.sum(axis=1) == 0, 0] = 1
    model = toxicity.ClassModels.fit(pairs[:, 0], pairs[:, 1], counts)
    names, chance = slow_kneser_ney([(int(v), int(w), *n) for (v, w), n in zip(pairs, counts)])
    for v in names:
        for w in names:
            got, _ = model.ratios(np.array([v], np.uint64), np.array([w], np.uint64))
            assert np.isclose(got[0], np.log(chance(1, v, w) / chance(0, v, w)))


def planted(n=900):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 5))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randint(5, 300))]
        toxic = i % 5 == 0
        for _ in range(toxic * rnd.randint(1, 4)):
            text[rnd.randrange(len(text))] = rnd.choice(["Vile,", "nasty", "rotten!"])
        docs.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def scored(spark, docs_of):
    docs, labels = planted()
    extra = [(2000, None), (2001, ""), (2002, " \n"), (2003, "nasty " * 30_000), (2004, "abc " * 40_000), (None, "vile nasty rotten"), docs[7]]
    labels += [(3000, 1, 1), (None, 1, 1), (5, None, None), (7, 0, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS text")
    out = toxicity.score_documents(docs_of(docs + extra).withColumnRenamed("lang", "score"), table).collect()
    return docs, out


def test_held_out_accuracy(scored):
    docs, out = scored
    assert len(out) == len(docs) + 7
    held = [r for r in out if r.held_out and r.doc_id < 900]
    assert {r.doc_id for r in held} == {i for i, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    right = [r.predicted == (r.doc_id % 5 == 0) for r in held]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)


def test_awkward_rows(scored):
    by_id = {r.doc_id: r for r in scored[1]}
    assert by_id[2000].score == by_id[2001].score == by_id[2002].score < 0.3
    assert by_id[2003].predicted and not by_id[2004].predicted and by_id[None].predicted
    assert by_id[None].held_out is False


def test_held_out_labels_teach_nothing(spark, docs_of):
    docs, labels = planted(400)
    flip = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    a, b = (
        {r.doc_id: r.score for r in toxicity.score_documents(docs_of(docs), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()}
        for x in (labels, flip)
    )
    assert a == b


def test_copies_of_labelled_rows_teach_once(spark, docs_of):
    docs, labels = planted(300)
    taught = next(i for i, *_ in labels if i % 5 == 0 and zlib.crc32(str(i).encode()) % 4 != 2)
    other = next(i for i, *_ in labels if i % 5 and zlib.crc32(str(i).encode()) % 4 != 2)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    once = {r.doc_id: round(r.score, 6) for r in toxicity.score_documents(docs_of(docs), table).collect()}
    many = toxicity.score_documents(docs_of(docs + [docs[taught]] * 300 + [docs[other]] * 300), table).collect()
    assert len(many) == len(docs) + 600 and {(r.doc_id, round(r.score, 6)) for r in many} == set(once.items())


def test_without_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.score_documents(docs_of(["a", "b"]), none).collect()} == {0}
    assert toxicity.score_documents(docs_of([]), none).count() == 0


def test_expressions_of_few_texts_count(spark, docs_of):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 5))) for _ in range(300)]
    slurs = [f"slur{chr(97 + i)}" for i in range(20)]
    docs, labels = [], []
    for i in range(800):
        text = [rnd.choice(words) for _ in range(rnd.randint(20, 80))]
        if i % 5 == 0:
            text[rnd.randrange(len(text))] = slurs[i // 5 % 20]  # each in about eight texts, six of them outside the held-out fold
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(i % 5 == 0)))
    out = toxicity.score_documents(docs_of(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [r for r in out if r.held_out]
    found = [r for r in held if r.doc_id % 5 == 0 and r.predicted]
    assert len(found) > 0.8 * sum(r.doc_id % 5 == 0 for r in held)
    assert sum(r.predicted for r in held) - len(found) < 0.05 * len(held)
