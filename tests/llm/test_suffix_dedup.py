"""Repeated byte strings against brute force: planted passages, copies, periodic and awkward texts."""

import hashlib
import os
import random

import numpy as np
import pytest

from tablesmith import session
from tablesmith.llm import suffix_dedup


def brute(rows):
    """Per document (id None first, then id): kept bytes and number of spans."""
    seen, out = set(), {}
    for i, data in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            w = data[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[i] = (len(data), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_windows_of_a_shard():
    rnd = random.Random(1)
    for _ in range(150):
        base = bytes(rnd.choice(b"ab\x00\xff") for _ in range(400))
        rows = []
        for _ in range(rnd.randint(1, 12)):
            part = bytearray(base[(a := rnd.randint(0, 250)) : a + rnd.randint(100, 176)])
            if rnd.random() < 0.7:
                part[rnd.randrange(len(part))] = rnd.choice(b"ab\x00\xff")
            rows.append(bytes(part) if rnd.random() < 0.8 else b"a" * len(part))
        rows = [r for r in rows if len(r) >= 100]
        starts, at = [], 0
        for r in rows:
            starts += range(at, at + len(r) - 99)
            at += len(r)
        data, seen, want = b"".join(rows), set(), []
        for s in starts:
            want.append(data[s : s + 100] in seen)
            seen.add(data[s : s + 100])
        got = suffix_dedup.repeated_windows(data, np.array(starts, np.int64))
        assert got[starts].tolist() == want and got.sum() == sum(want)


def corpus():
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdéfgh") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passages = [text(60) for _ in range(4)]
    docs = [text(rnd.randint(0, 120)) for _ in range(30)]
    for _ in range(40):
        p = rnd.choice(passages).split()
        a = rnd.randint(0, 20)
        docs.append(f"{text(rnd.randint(0, 40))} {' '.join(p[a : a + rnd.randint(20, 60)])} {text(rnd.randint(0, 40))}")
    near = text(200).split()
    for _ in range(25):
        copy = list(near)
        for _ in range(rnd.randint(0, 3)):
            copy[rnd.randrange(200)] = rnd.choice(words)
        docs.append(" ".join(copy))
    docs += ["a" * 3000, "ab" * 700, "xyz " * 400, "", "a" * 99, "a" * 100, docs[35] * 3, text(20_000), "a" * 250]
    rnd.shuffle(docs)
    rows = [(3 * i, t) for i, t in enumerate(docs)]
    return rows + [(1000, None), (None, docs[50]), rows[8], rows[8], (1001, docs[8])]


@pytest.mark.parametrize("hot_contents", [4096, 2])
def test_documents(docs_of, hot_contents):
    rows = corpus()
    docs = docs_of(rows).withColumnRenamed("lang", "start").withColumnRenamed("source", "anchor")
    got = suffix_dedup.remove_repeats(docs, hot_contents=hot_contents).collect()
    want = brute([(i, (t or "").encode()) for i, t in rows])
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_a_shard_that_names_cannot_span_is_refused():
    with pytest.raises(ValueError):
        suffix_dedup.repeated_windows(bytes(1 << 21), np.zeros(1, np.int64))


def test_hot_passage_with_false_hits(docs_of, monkeypatch):
    """A filter that lets everything through sends all copies of a passage to one anchor's task; it holds each content once."""
    rnd = random.Random(4)
    passage = "".join(rnd.choice("abcdef ") for _ in range(300))
    rows = [(i, f"{i % 7} {passage} {'xyz' * (i % 3)}") for i in range(400)]
    monkeypatch.setattr(suffix_dedup, "in_bloom", lambda words, seeds: np.ones(len(seeds), bool))
    got = suffix_dedup.remove_repeats(docs_of(rows)).collect()
    want = brute([(i, t.encode()) for i, t in rows])
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] for r in got)


def test_what_a_step_no_longer_needs_is_deleted(spark, docs_of, monkeypatch):
    """As the suffixes are sorted, the tables that found them and the shuffles of the steps before are gone; whole texts are not shuffled."""
    kept, left = [], []
    path, key = session.scratch_path, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    monkeypatch.setattr(session, "scratch_path", lambda s, name: (kept.append(path(s, name)), kept[-1])[1])
    shards = suffix_dedup._sorted_shards
    seen = lambda *a: (left.extend(p.split("/tablesmith-")[1][:-33] for p in kept if os.path.exists(p.removeprefix("file:"))), left.append(spark.conf.get(key)), shards(*a))[-1]
    monkeypatch.setattr(suffix_dedup, "_sorted_shards", seen)
    before = spark.conf.get(key)
    rows = corpus()
    got = suffix_dedup.remove_repeats(docs_of(rows), with_kept=False)
    assert left == ["copies", "hot-anchors", "suffixes", "true"] and spark.conf.get(key) == before
    want = brute([(i, (t or "").encode()) for i, t in rows])
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] for r in got.collect())
    mapped = got._jdf.queryExecution().analyzed().toString()
    assert mapped.count("MapInArrow") == 2


def test_small_tables(docs_of):
    assert suffix_dedup.remove_repeats(docs_of([])).count() == 0
    (row,) = suffix_dedup.remove_repeats(docs_of([None]), with_kept=False).collect()
    assert (row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256) == (0, 0, 0, hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("hot_contents", [4096, 1])
def test_rows_of_one_id_are_judged_by_place(docs_of, hot_contents):
    rnd = random.Random(7)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    base = text(600)
    cut = lambda: base[(a := rnd.randint(0, 300)) : a + rnd.randint(100, 300)]
    rows = [(rnd.choice([None, 1, 1, 2, 3]), text(rnd.randint(0, 60)) + cut() + text(rnd.randint(0, 60))) for _ in range(60)]
    rows += [(2, base), (2, base), (2, base[:300] + text(50)), (1, "a" * 260), (1, "a" * 150), (3, "ab" * 120), (3, "ba" * 120)]
    first: dict[bytes, tuple] = {}
    for i, t in rows:
        for s in range(len(t) - 99):
            at = (i is not None, i or 0, s)
            first[t[s : s + 100]] = min(first.get(t[s : s + 100], at), at)
    want = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - 99):
            if first[t[s : s + 100]] < (i is not None, i or 0, s):
                gone[s : s + 100] = True
        kept = "".join(c for c, g in zip(t, gone) if not g)
        want.append((i or 0, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept.encode()).hexdigest()))
    got = suffix_dedup.remove_repeats(docs_of(rows), hot_contents=hot_contents).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
