"""The near-duplicate stage against all pairs of documents compared by brute force."""

import itertools
import random

import corpus_pipeline
from tablesmith.llm import similar


def slow_set(text, width):
    words = text.encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def slow_groups(texts, width=5, similarity=0.8):
    sets, root = [slow_set(t or "", width) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] == sets[b] or len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(i) for i in range(len(texts))]


def corpus():
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(rnd.choice(words) for _ in range(40))
    texts = [None, "", " \n", "one two", "ONE two", "one two three four", "a b c d e"]
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(rnd.choice([6, 12, 40, 150, 400]))]
        texts.append(" ".join(base))
        for _ in range(rnd.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 2, 4, 8, 14])):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(" ".join(copy))
        texts.append(passage + " " + " ".join(rnd.choice(words) for _ in range(rnd.choice([3, 9, 30]))))
    texts.append(texts[8])
    rnd.shuffle(texts)
    return texts


def test_shingle_sets():
    texts = [t or "" for t in corpus()]
    for width in (2, 5):
        assert [len(s) for s in similar.shingle_sets(texts, width)] == [len(slow_set(t, width)) for t in texts]


def test_stage_is_all_pairs(spark, docs_of):
    texts = corpus()
    want = slow_groups(texts)
    got = corpus_pipeline.near_duplicate_stage(spark, docs_of(texts), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want))
    assert len(set(want)) < len(set(slow_groups(texts, similarity=1.0)))


def test_other_width_and_similarity(docs_of):
    texts = corpus()
    for width, similarity in ((3, 0.6), (1, 0.9)):
        assert sorted(r.doc_id for r in similar.drop_similar(docs_of(texts), width, similarity).collect()) == sorted(set(slow_groups(texts, width, similarity)))


def test_shared_footer_makes_no_pairs(spark, docs_of, monkeypatch):
    """Texts with one footer and nothing else in common: what is compared grows with the texts, not their pairs."""
    rnd = random.Random(8)
    footer = " ".join(f"footer{i}" for i in range(16))
    compared = []
    alike = similar._alike

    def counted(pairs, *args):
        pairs = pairs.select("a", "b").distinct()
        compared.append(pairs.count())
        return alike(pairs, *args)

    monkeypatch.setattr(similar, "_alike", counted)
    texts = [" ".join(f"w{rnd.randrange(10**9)}" for _ in range(40)) + " " + footer for _ in range(400)]
    near = " ".join(f"n{i}" for i in range(80)).split()
    for i in range(60):
        texts.append(" ".join([*near[:i], "other", *near[i + 1 :]]))
    assert similar.drop_similar(docs_of(texts)).count() == 401
    assert sum(compared) < 3 * len(texts)


def test_fingerprints_propose_pairs(spark, docs_of, monkeypatch):
    """Pairs within two bits, found in BK-trees, go to the exact comparison, and only those of them that are alike link."""
    proposed = []
    near = similar._near_prints

    def seen(sets, keep):
        pairs = near(sets, keep)
        rows = {r.id: r.fp for r in sets.select("id", "fp").collect()}
        proposed.append({(rows[r.a] ^ rows[r.b]) % 2**64 for r in pairs.collect()})
        return pairs

    monkeypatch.setattr(similar, "_near_prints", seen)
    texts = corpus()
    base = " ".join(f"b{i}" for i in range(600)).split()
    texts += [" ".join([*base[:i], "other", *base[i + 1 :]]) for i in range(0, 600, 10)]
    got = corpus_pipeline.near_duplicate_stage(spark, docs_of(texts), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(slow_groups(texts)))
    assert proposed[0] and max(d.bit_count() for d in proposed[0]) in (1, 2)


def test_grades_are_powers_of_two(spark, docs_of, monkeypatch):
    monkeypatch.setattr(similar, "SAMPLED", 1)
    texts = [f"a b c d e x{i} y{i} z{i} {'f g h i j' if i % 4 == 0 else f'k{i}'}" for i in range(40)] + ["a b c d e x0 y0 z0 f g h i j"]
    with similar.scratch_tables(spark) as keep:
        common = similar._common_shingles(docs_of(texts).select("text"), 5, keep)
    sets = similar.shingle_sets(["a b c d e", "f g h i j", "x1 y1 z1 k1 k2"], 5)
    assert [similar._grades(common, s)[0] for s in sets] == [5, 3, 0]


def test_unrelated_texts_without_id_or_under_one_id_stay(spark, docs_of):
    rows = [(None, "quite some words that stand alone"), (None, "and another text of its own"), (4, "here is a third one too"), (4, "which shares an id with this"), (4, "which shares an id with this")]
    assert corpus_pipeline.near_duplicate_stage(spark, docs_of(rows), "").count() == 4
    assert corpus_pipeline.near_duplicate_stage(spark, docs_of([]), "").count() == 0


def test_pairs_too_far_apart_never_fetch_texts(spark, docs_of, monkeypatch):
    """Near copies that fall short of the similarity share many shingles; their sketches rule them out, and no similar pair."""
    compared = []
    alike = similar._alike

    def counted(pairs, *args):
        compared.append(pairs.select("a", "b").distinct().count())
        return alike(pairs, *args)

    monkeypatch.setattr(similar, "_alike", counted)
    base = [f"b{i}" for i in range(400)]
    texts = []
    for i in range(30):  # any two differ in 24 words: similarity about 0.54
        copy = list(base)
        for j in range(12):
            copy[(i + 33 * j) % 400] = f"own{i}x{j}"
        texts.append(" ".join(copy))
    assert sorted(set(slow_groups(texts))) == list(range(30))
    assert similar.drop_similar(docs_of(texts)).count() == 30
    assert sum(compared) == 0


def test_sketches_bound_the_difference():
    sets = similar.shingle_sets([t or "" for t in corpus()])
    sketches = [similar.odd_sketch(s) for s in sets]
    for a, x in zip(sets, sketches):
        for b, y in zip(sets, sketches):
            assert int.from_bytes((x ^ y).tobytes()).bit_count() <= len(set(a.tolist()) ^ set(b.tolist()))


def test_only_wanted_texts_are_shuffled(spark, docs_of):
    """Rows that are alone in their group never meet an exchange."""
    texts = [f"text number {i} of words {i * i} alone {i * 7}" for i in range(300)] + ["the very same words here again"] * 2
    out = similar.drop_similar(docs_of(texts))
    assert sorted(r.doc_id for r in out.collect()) == list(range(301))
    assert "Union" in out._jdf.queryExecution().executedPlan().toString()
