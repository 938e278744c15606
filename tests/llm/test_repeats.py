"""Repeated word windows against brute force: passages, near copies, periodic and awkward texts."""

import hashlib
import random

import numpy as np
import pytest

from tablesmith.llm import repeats
from tablesmith.llm.words import hash_words

BLANKS = " \t\n\x0b\x0c\r"


def split(text):
    out = [""]
    for c in text:
        if c in BLANKS:
            out.append("")
        else:
            out[-1] += c
    return [w for w in out if w]


def brute(rows, size):
    """For each distinct row in order (id None first): words, words removed, digest of the rest."""
    seen, out = set(), {}
    for i, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        words = split(text or "")
        gone = set()
        for s in range(len(words) - size + 1):
            w = tuple(words[s : s + size])
            if w in seen:
                gone |= set(range(s, s + size))
            seen.add(w)
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        out[i] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def corpus():
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abCdéf.,") for _ in range(rnd.randint(1, 5))) for _ in range(60)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passages = [text(70).split() for _ in range(4)]
    docs = [text(rnd.randint(0, 90)) for _ in range(25)]
    for _ in range(40):
        p = rnd.choice(passages)
        a = rnd.randint(0, 40)
        docs.append(f"{text(rnd.randint(0, 30))}\n{'  '.join(p[a : a + rnd.randint(12, 60)])}\t{text(rnd.randint(0, 30))}")
    near = text(160).split()
    for _ in range(25):
        copy = list(near)
        for _ in range(rnd.randint(0, 4)):
            copy[rnd.randrange(160)] = rnd.choice(vocabulary)
        docs.append(" ".join(copy))
    docs += ["a " * 300, "a b " * 100, "x y z " * 40, "", " \n ", "a " * 19, "a " * 20, docs[30] + "\n" + docs[30], text(6000), "b " * 21, "A B " * 30, "w v " * 25]
    rnd.shuffle(docs)
    rows = [(3 * i, t) for i, t in enumerate(docs)]
    return rows + [(1000, None), (None, docs[40]), rows[8], rows[8], rows[8], (1001, docs[8])]


def test_runs_hold_every_window_once():
    rnd = random.Random(3)
    for size in (1, 2, 3, 4, 5, 7, 8, 13, 20, 21):
        texts = [" ".join(rnd.choice("abc") for _ in range(rnd.choice([0, 1, 5, 19, 20, 45, 200]))).encode() for _ in range(20)]
        words, bounds = hash_words(texts)
        found = repeats.runs(words, bounds, size)
        got = sorted(w for f, n in zip(found["first"], found["count"]) for w in range(f, f + n))
        want = [s for a, b in zip(bounds, bounds[1:]) for s in range(a, b - size + 1)]
        assert got == want
        assert (found["count"] <= size).all()
        # windows of equal words have equal quarters and halves, wherever they stand
        flat, of = [w for t in texts for w in t.split()], {}
        for f, n, q, h in zip(found["first"], found["count"], found["quarter"], found["half"]):
            for w in range(f, f + n):
                of.setdefault(tuple(flat[w : w + size]), set()).add((q, h))
        assert all(len(v) == 1 for v in of.values())


def test_lengths_at_most_double():
    for size in range(1, 60):
        a, b, c = repeats.levels(size)
        assert 1 <= a <= b <= c == size and b <= 2 * a and c <= 2 * b


@pytest.mark.parametrize("size", [20, 7, 3])
def test_documents(docs_of, size):
    rows = corpus()
    docs = docs_of(rows).withColumnRenamed("lang", "start").withColumnRenamed("source", "half")
    got = repeats.remove_repeated_windows(docs, size).collect()
    want = brute(rows, size)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256, r.kept) == want[r.doc_id], r.doc_id
    assert sum(r.n_removed for r in got) > 100


def test_one_passage_everywhere(docs_of):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(i, f"q{i} r{i} {passage} s{i}") for i in range(300)] + [(300 + i, passage) for i in range(50)]
    got = repeats.remove_repeated_windows(docs_of(rows)).collect()
    want = brute(rows, 20)
    assert all((r.n_words, r.n_removed, r.kept_sha256, r.kept) == want[r.doc_id] for r in got)


def test_small_tables(docs_of):
    assert repeats.remove_repeated_windows(docs_of([])).count() == 0
    (row,) = repeats.remove_repeated_windows(docs_of([None]), with_kept=False).collect()
    assert (row.n_words, row.n_removed, row.kept_sha256) == (0, 0, hashlib.sha256(b"").hexdigest())
    assert repeats.remove_repeated_windows(docs_of(["a b c d"])).first().n_removed == 0
    with pytest.raises(ValueError):
        repeats.repeated_spans(docs_of([]), 0)


def test_hashes_double():
    words = np.arange(50, dtype=np.uint64)
    assert len(repeats.runs(words[:19], np.array([0, 19]), 20)["first"]) == 0
