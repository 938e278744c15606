"""Line dedup, quality rules and chat formatting on small tables and awkward rows."""

import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablesmith.llm import chat, line_dedup, quality


def brute_lines(rows, min_docs):
    blanks = " \t\n\x0b\x0c\r"
    key = lambda s: "".join(c.lower() if c.isascii() else c for c in s.strip(blanks))
    found = Counter()
    for _, text in set((i, t or "") for i, t in rows):
        found.update({key(x) for x in text.split("\n")})
    common = {k for k, n in found.items() if n >= min_docs and k}
    return [(i, "\n".join(x for x in (t or "").split("\n") if key(x) not in common)) for i, t in rows]


@pytest.mark.parametrize("min_docs", [2, 3])
def test_line_dedup(docs_of, min_docs):
    rnd = random.Random(min_docs)
    lines = ["alpha", " ALPHA\t", "beta", "", "  ", "Élan", "élan", "rare one"]
    rows = [(i, "\n".join(rnd.choice(lines) + ("" if rnd.random() < 0.7 else str(i)) for _ in range(rnd.randint(1, 6)))) for i in range(12)]
    rows += [(100, None), (101, ""), (None, "alpha\nx"), (7, rows[7][1]), (102, "alpha"), (103, "gamma\n" * 5000)]
    got = line_dedup.drop_common_lines(docs_of(rows), min_docs).collect()
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.text) for r in got), key=order) == sorted(brute_lines(rows, min_docs), key=order)
    assert {r.n_lines for r in got if r.doc_id in (100, 101)} == {1}


def test_line_dedup_keeps_other_columns(spark, docs_of):
    docs = docs_of(["a\nb", "a\nc"]).withColumnsRenamed({"lang": "key", "source": "n_dropped", "n_chars": "line"})
    got = line_dedup.drop_common_lines(docs, 2).orderBy("doc_id")
    assert got.columns == ["doc_id", "key", "line", "text", "n_lines", "n_dropped"]
    assert [(r.text, r.n_dropped, r.key) for r in got.collect()] == [("b", 1, "en"), ("c", 1, "en")]
    assert line_dedup.drop_common_lines(docs_of([]), 2).count() == 0


def brute_repeats(words):
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    return len({j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)})


def test_only_blanks_are_stripped_off_lines(docs_of):
    """A blank before a line separator that is no blank belongs to the line."""
    rows = [f"own {i}\n\v Same \x0c\r" for i in range(10)] + ["edge \u2028"] * 5 + ["edge\u2028"] * 5 + ["tail \x85"] * 5 + ["tail\x85"] * 5
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.drop_common_lines(docs_of(rows), 10).collect()}
    assert [got[i] for i in range(10)] == [(f"own {i}", 1) for i in range(10)]
    assert [got[i] for i in range(10, 30)] == [(t, 0) for t in rows[10:]]


def test_measures(docs_of):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 30))) for _ in range(40)]
    texts += [None, "", " \t", "a b c\nx\na b c\n\n\n", "# <b>\x0b|é漢", "w " * 20_000]
    got = {r.doc_id: r for r in quality.measure(docs_of(texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        words, lines = t.split(), [x for x in t.split("\n") if x.split()]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), brute_repeats(words))
        assert (r.n_symbols, r.n_dup_lines) == (sum(c in "[#*$%&|<>]"[1:-1] for c in t), len(lines) - len(set(lines)))


def test_host_verdicts(spark, docs_of):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, good if i % 10 else "short", "good") for i in range(50)] + [(100 + i, "short" if i else good, "bad") for i in range(50)]
    rows += [(400 + i, good, f"fine{i % 2}") for i in range(20)]
    rows += [(200, "short", "tiny"), (201, good, "tiny"), (300, good, None), (301, None, None), (300, good, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS kept", "2 AS n_words")
    out = {(r.doc_id, r.source): r for r in quality.quality_rules(docs).collect()}
    assert len(out) == len(rows) - 1 and quality.quality_rules(docs).count() == len(rows)
    assert not out[100, "bad"].base_failed and out[100, "bad"].host_rejected and not out[100, "bad"].kept
    assert out[1, "good"].kept and not out[0, "good"].kept
    assert out[201, "tiny"].kept and out[300, None].kept and not out[301, None].kept
    hosts = {r.host: r for r in quality.host_verdicts(quality.measure(docs)).collect()}
    assert 0.1 < hosts["good"].shrunk_rate < 0.5 < hosts["bad"].shrunk_rate < 0.98
    assert quality.quality_rules(docs_of([])).count() == 0


_TEXT = st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "<", "|", "\\", "\n", "n", "<\\|", "im_end", "user", "é"]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(_TEXT, _TEXT), max_size=4))
def test_chat_round_trip(turns):
    parts = [chat.render(role, text) for role, text in turns]
    assert chat.parse("".join(p[0] for p in parts)) == turns
    for (_, text), (_, level, shown) in zip(turns, parts):
        assert level or shown == text


def test_chat_parser_refuses():
    for bad in ("x", "<|im_start|>user<|im_end|>\n", "<|im_start|>u\nt<|im_end|>", "<|im_end|>u\nt<|im_start|>\n", "<|im_start|>u\nt<|im_end|>\n "):
        assert chat.parse(bad) is None


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", "a"), (1, 1, "assistant", "b<|im_end|>"), (None, None, None, None), (2, 0, "assistant", None)]
    rows += [(3, i, "assistant" if i % 2 else "user", "x\\<|" * i) for i in range(300)]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS rendered")
    turns = chat.format_turns(chats)
    got = {r.conv_id: r for r in chat.digest_turns(turns).collect()}
    for conv in (1, 2, 3, None):
        own = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv) if conv else [(0, "", "")]
        loss = "".join(x for _, r, x in own if r == "assistant")
        want = (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == want
    for r in turns.where("loss_chars > 0").collect():
        assert chat.unescape(r.rendered[r.loss_from : r.loss_from + r.loss_chars]) == r.text
    assert chat.digest_turns(chat.format_turns(chats.limit(0))).count() == 0
