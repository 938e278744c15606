"""The code is complete, the base model equals brute force, the mixed one beats it on held-out texts, awkward rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tablesmith.llm import mixing


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text))


def test_code_is_a_complete_prefix_code():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 3000):
        counts = np.sort(rng.zipf(1.5, n).clip(1, 10**6))[::-1]
        code = mixing.Code.make(np.unique(rng.integers(1, 2**62, n).astype(np.uint64))[:n], counts, 7, 9)
        assert sum(2.0 ** -int(x) for x in code.length) == 1
        paths = {format(int(c), f"0{int(k)}b") for c, k in zip(code.code, code.length)}
        assert len(paths) == n + 2 and not any(a != b and b.startswith(a) for a in sorted(paths) for b in sorted(paths)[:50])
        # the exact odds alone give each symbol its share of the counts
        weight = np.concatenate(([7, 9], code.counts))
        for s in range(min(n + 2, 60)):
            p = 1.0
            for d in range(code.length[s]):
                rest = int(code.length[s]) - d
                node = (int(code.code[s]) >> rest) + int(code.base[d])
                up = 1 / (1 + math.exp(-code.odds[node]))
                p *= up if int(code.code[s]) >> (rest - 1) & 1 else 1 - up
            assert p == pytest.approx(weight[s] / weight.sum(), rel=1e-4)


def test_all_texts_share_one():
    """Summed over every next bit, probabilities add up to one: cost of a bit and of its opposite."""
    rng = np.random.default_rng(2)
    texts = [b"the cat sat", b"", b"zebra the the xyzzy"]
    words = np.unique(mixing.spelled_words([b"the cat sat on"])[0])
    code = mixing.Code.make(words, np.array([9, 5, 4, 3]), 3, 2)
    shape = (2 * mixing.TABLES, 1 << mixing.TABLE_LOG2)
    model = mixing.learn(code, rng.integers(-50, 50, shape).astype(np.int8), texts)
    parsed = mixing.Texts(code, texts)
    for d in parsed.decisions(0, len(parsed.symbol)):
        own = np.zeros((3, 2, 1 + mixing.TABLES), np.float32)
        ahead = model.costs(d, own.copy())
        d.bit = 1 - d.bit
        assert np.allclose(np.exp(ahead) + np.exp(model.costs(d, own.copy())), 1, atol=1e-5)


def corpus():
    rnd = random.Random(3)
    syllables = ["ba", "ne", "ko", "ri", "tu", "sha", "mé"]
    common = ["the", "of", "and", "a"]
    word = lambda: rnd.choice(common) if rnd.random() < 0.5 else "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3)))
    docs = [(i, " ".join(word().title() if rnd.random() < 0.1 else word() for _ in range(rnd.randint(1, 150)))) for i in range(400)]
    return docs + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "the " * 20_000), (1004, "x" * 30_000), (None, "the ba of"), docs[3]]


@pytest.fixture(scope="module")
def scored(docs_of):
    docs = corpus()
    table = docs_of(docs).withColumnRenamed("lang", "word").withColumnRenamed("source", "key")
    return docs, mixing.score_documents(table).collect()


def test_base_is_brute_force(scored):
    docs, out = scored
    held = {i for i, _ in docs if i is not None and zlib.crc32(str(i).encode()) % 7 == 2}
    counts = Counter(w for i, t in docs if i not in held for w in [*words_of(t or ""), "\n"])
    total, kinds = sum(counts.values()), len(counts)
    by_id = {i: t or "" for i, t in docs}
    assert len(out) == len(docs)
    for r in out:
        words = [*words_of(by_id[r.doc_id]), "\n"]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (r.doc_id in held, len(words), total)
        assert r.n_known == sum(w in counts for w in words)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in words), rel=1e-9)
        assert r.score < 0 and r.bits_per_byte > 0


def test_mixed_model_is_better(scored):
    held = [r for r in scored[1] if r.held_out and r.doc_id < 1000]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_bounded_vocabulary_gives_the_same_base(docs_of, scored):
    few = {r.doc_id: r for r in mixing.score_documents(docs_of(corpus()), frequent=10).collect()}
    for r in scored[1]:
        assert few[r.doc_id].base_score == pytest.approx(r.base_score, rel=1e-9) and few[r.doc_id].n_known == r.n_known


def test_small_tables(docs_of):
    assert mixing.score_documents(docs_of([])).count() == 0
    (row,) = mixing.score_documents(docs_of([None])).collect()
    assert row.n_tokens == 1 and row.score < 0


def test_every_training_document_teaches_tables_weights_and_map(spark, docs_of):
    """The model is that of all texts: its counts, and as many lessons as there are decisions."""
    texts = [t or "" for i, t in corpus() if i is not None and i < 1000]
    words, n = np.unique(mixing.spelled_words([t.encode().lower() for t in texts])[0], return_counts=True)
    code = mixing.Code.make(words[n > 2], n[n > 2], len(texts), int(n[n < 3].sum()))
    made = mixing._model(docs_of(texts).coalesce(1).select("text"), code)
    total = np.zeros((2 * mixing.TABLES, 1 << mixing.TABLE_LOG2, 2), np.int64)
    bits = 0
    for d in mixing.Texts(code, [t.encode() for t in texts]).all_decisions():
        for k, slot in enumerate(d.slots):
            np.add.at(total[d.first_table + k], (slot, d.bit.astype(int)), 1)
        bits += len(d.bit)
    assert (made.tables == mixing._odds(total)).all()
    counts = mixing.Counts(code)
    for group in mixing._growing(iter(texts)):
        counts.add([t.encode() for t in group])
    assert counts.n == counts.lessons.seen.sum() == bits
    again = mixing.Lessons.model(code, made.tables, counts.lessons.sums())
    assert np.array_equal(made.weights, again.weights) and np.array_equal(made.refined, again.refined)


def test_weights_of_tasks_are_averaged_by_use():
    code = mixing.Code.make(np.arange(1, 4, dtype=np.uint64), np.array([5, 4, 3]), 2, 2)
    one, two = mixing.Lessons(), mixing.Lessons()
    one.weights[0], two.weights[0], one.seen[0], two.seen[1] = 1, 2, 30, 10
    made = mixing.Lessons.model(code, np.zeros((0, 0), np.int8), one.sums() + two.sums())
    assert made.weights[0] == pytest.approx(1.25) and (made.weights[1:] == mixing.Lessons().weights[1:]).all()


def test_score_is_brute_force():
    """Decision by decision, from the code, tables, weights and map alone."""
    texts = [t or "" for i, t in corpus() if i is not None and i < 1000][:50] + ["the xyzzy the", ""]
    words, n = np.unique(mixing.spelled_words([t.encode().lower() for t in texts])[0], return_counts=True)
    code = mixing.Code.make(words[n > 2], n[n > 2], len(texts), int(n[n < 3].sum()))
    counts = mixing.Counts(code)
    for group in mixing._growing(iter(texts)):
        counts.add([t.encode() for t in group])
    model = mixing.Lessons.model(code, np.stack([mixing._odds(x) for x in counts.total]), counts.lessons.sums())
    got = model.scores([t.encode() for t in texts])[1]
    for t, score in zip(texts, got):
        total = 0.0
        for d in mixing.Texts(code, [t.encode()]).all_decisions():
            own = np.zeros(4)
            for a in range(0, len(d.bit), mixing.BLOCK):
                step = np.zeros(4)
                for i in range(a, min(a + mixing.BLOCK, len(d.bit))):
                    entries = [int(model.tables[d.first_table + k][slot[i]]) for k, slot in enumerate(d.slots)]
                    x = np.array([0.3 if d.exact is None else d.exact[i], *(e / 16 for e in entries)])
                    gate = int(d.gate[i]) + sum(abs(entries[-1]) > 16 * least for least in (0.5, 1.5, 3))
                    z = np.clip(np.clip(model.weights[gate] @ x, -20, 20) + own @ x, -20, 20)
                    p = min(max(1 / (1 + math.exp(-z)), 1e-5), 1 - 1e-5)
                    step += (d.bit[i] - p) * x
                    p = (p + model.refined[gate * 33 + round(min(max(z, -8), 8) * 2) + 16]) / 2
                    total += math.log10(p if d.bit[i] else 1 - p)
                own += mixing.OWN_RATE / mixing.BLOCK * step
        assert score == pytest.approx(total, rel=1e-3)
