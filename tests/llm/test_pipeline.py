"""The pipeline against the same decisions taken one document after the other, at the smallest scale."""

from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from tablesmith.llm import bpe, decontam

SF_DIR = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"


def shingles(text):
    """The set of five-word shingles, ASCII case folded; a shorter text is one shingle."""
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(docs, items):
    """Ids and texts that pass the first four stages."""

    def measures(text):
        words, lines = text.split(), [x for x in text.split("\n") if x.split()]
        windows = Counter(zip(words, words[1:], words[2:]))
        repeated = len({j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(i, i + 3)})
        chars, symbols = sum(map(len, words)), sum(c in "#*$%&|<>" for c in text)
        base = len(words) < 50 or 100 * repeated > 50 * len(words)
        odd = 100 * symbols > 20 * chars or chars < 2 * len(words) or chars > 20 * len(words)
        return base, base or odd or 100 * (len(lines) - len(set(lines))) > 50 * len(lines)

    rated = {i: measures(t or "") for i, t, _ in docs}
    hosts = {}
    for i, _, s in docs:
        hosts.setdefault(s, []).append(rated[i][1])
    rates = [np.mean(v) for v in hosts.values()]
    mean, var = np.mean(rates), np.var(rates)
    weight = mean * (1 - mean) / var - 1 if var > 0 else 0
    weight = weight if weight > 0 else np.mean([len(v) for v in hosts.values()])
    bad = {s for s, v in hosts.items() if (sum(v) + mean * weight) / (len(v) + weight) > 0.5}
    docs = [(i, t or "") for i, t, s in docs if not rated[i][0] and s not in bad]

    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(BLANKS))
    spread = Counter(k for _, t in docs for k in {key(x) for x in t.split("\n")})
    docs = [(i, "\n".join(x for x in t.split("\n") if not (key(x) and spread[key(x)] >= 10))) for i, t in docs]
    docs = [(i, t) for i, t in docs if t.strip(BLANKS)]

    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    docs = [(i, t) for i, t in docs if find(i) == i]

    goals = [decontam.tokens(t) for _, t in items]
    leaked = lambda t: any(g and sum(n for *_, n in decontam.tile(g, t)) >= 0.5 * len(g) for g in goals)
    return {i: t for i, t in docs if not leaked(decontam.tokens(t))}


@pytest.fixture(scope="module")
def result(spark):
    return corpus_pipeline.run(spark, SF_DIR).collect()


def test_run_is_brute_force(result):
    docs = duckdb.sql(f"SELECT doc_id, text, source FROM '{SF_DIR}/documents.parquet'").fetchall()
    want = brute(docs, duckdb.sql(f"SELECT item_id, text FROM '{SF_DIR}/benchmark.parquet'").fetchall())
    assert sorted(r.doc_id for r in result) == sorted(want)
    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")).ranks
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in result:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(want[r.doc_id])


def test_stages_keep_columns_and_take_awkward_rows(spark):
    good = " ".join(f"word{i}" for i in range(70))
    rows = [(1, good, "n"), (1, good, "n"), (2, None, "n"), (3, "", "n"), (None, " ".join(f"other{i * i}" for i in range(60)), None), (4, "shared line\n" + good[::-1], "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "7 AS kept", "'x' AS key", "-1 AS n_lines", "length(text) AS n_chars")
    for table in (docs, docs.limit(0)):
        now = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            then = now
            now = stage(spark, then, SF_DIR)
            assert now.columns == table.columns
        assert {(r.kept, r.key, r.n_lines, r.n_chars == len(r.text)) for r in now.collect()} <= {(7, "x", -1, True)}
        assert corpus_pipeline.STAGES[-1][1](spark, now, SF_DIR).count() == (3 if table is docs else 0)
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
