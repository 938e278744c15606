"""Encoding against the public libraries, exact counts at every prefix, awkward rows."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from tablesmith.llm import bpe, pretokens, token_counts

RANKS, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
BITS = ["a", "the", " ", "  ", "\n", "'", "s", "re", "l", "'ll", "1", "é", "²", "!", "\t", "x'", "漢", " '", "ing", "\x1c", " ", "🙂"]


def some_texts(n, longest=14, bits=BITS, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    vocab = bpe.load_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


def test_pieces_follow_the_pattern():
    pattern = regex.compile(P.PATTERN)
    for text in some_texts(5000):
        assert [x.encode() for x in pattern.findall(text)] == pretokens.pieces(text), repr(text)


def test_ids_are_the_librarys(library):
    rnd = random.Random(3)
    long = ["a" * 30_000, "ab" * 10_000, " " * 20_000, "".join(rnd.choice("abcdefgh") for _ in range(40_000))]
    texts = some_texts(2000, 60) + long
    enc = bpe.Encoder(bpe.load_ranks(RANKS))
    for text, ids in zip(texts, enc.encode_all(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert enc.decode(ids) == text.encode()


def test_queue_follows_merge_order_in_any_vocabulary():
    """Vocabularies not made by merging too: a later pair may have a lower rank."""
    rnd = random.Random(5)
    for _ in range(200):
        words = {bytes([b]) for b in range(256)}
        own = {"".join(rnd.choice("abc") for _ in range(rnd.randint(2, 5))).encode() for _ in range(12)}
        ranks = {w: i for i, w in enumerate(rnd.sample(sorted(words | own), len(words | own)))}
        vocab = bpe.Ranks(ranks)
        parts = ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 12))).encode() for _ in range(20)]
        for part, ids in zip(parts, bpe.encode_pieces(vocab, parts)):
            want = [ranks[part]] if part in ranks else bpe._one_by_one(vocab, part)
            assert ids.tolist() == want, (part, ranks)


def test_documents(docs_of, library):
    docs = docs_of([(1, "The cat's hat"), (1, "The cat's hat"), (None, None), (2, ""), (3, "x" * 50_000)])
    rows = bpe.encode_documents(docs, RANKS).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows)[:2] == [(0, 0), (1, len(library.encode_ordinary("The cat's hat")))]
    for r in rows:
        text = {1: "The cat's hat", 3: "x" * 50_000}.get(r.doc_id, "")
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(text)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(r.ids).hexdigest()
    assert bpe.encode_documents(docs_of([]), RANKS).count() == 0


def test_counts_at_every_prefix():
    lib, merges = Tokenizer.from_file(JSON), token_counts.load_merges(JSON)
    for text in some_texts(600, 10, [*BITS, "<|endoftext|>"], 2):
        got = token_counts.prefix_counts(merges, text).tolist()
        assert got == [len(lib.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)], repr(text)


def test_count_documents(docs_of):
    lib = Tokenizer.from_file(JSON)
    texts = ["", None, "a<|endoftext|>b", "word " * 600, "z" * 30_000, *some_texts(50, 40)]
    docs = docs_of(texts).withColumnRenamed("lang", "n_tokens")
    plain = {r.doc_id: r for r in token_counts.count_tokens(docs, JSON).collect()}
    full = {r.doc_id: r for r in token_counts.count_tokens(docs, JSON, limit=7, with_prefix=True).collect()}
    for i, text in enumerate(texts):
        text = text or ""
        n = len(lib.encode(text, add_special_tokens=False).ids)
        assert (plain[i].n_tokens, plain[i].n_bytes, plain[i].over_limit) == (n, len(text.encode()), n > 512)
        assert full[i].n_tokens == n and len(full[i].prefix_tokens) == len(text) + 1
        fits = full[i].fits_chars
        assert len(lib.encode(text[:fits], add_special_tokens=False).ids) <= 7
        assert fits == len(text) or min(full[i].prefix_tokens[fits + 1 :]) > 7
    assert token_counts.count_tokens(docs_of([]), JSON).count() == 0
