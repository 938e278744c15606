"""Toxicity by two interpolated Kneser-Ney word models, one of toxic and one of ordinary texts.

Each class has its own counts of word pairs, and of how many different words come before a word
(continuation counts). What discounting takes from a class's pairs goes to the pairs of both classes
together, and from there to the class's continuation counts, which themselves back off to those of both:
so the shared counts alone decide how little a rare expression says. A text counts an expression once,
however often it repeats it, and both classes have equally many texts. A text is scored by the
difference of its log-likelihoods per word, over the whole text and over its most telling stretches,
and by its most telling single words; a logistic curve, fitted to each part of the labelled texts
through models of the other parts, makes it a score: the mean over these models.

The models are fitted on a bounded sample: ``SAMPLE_DOCS`` labelled texts of each class with
``SAMPLE_CHARS`` characters, and ``CURVE_DOCS`` for the curve, taken in the order of a hash of their
id. So what is collected and broadcast has a fixed bound. All documents are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.bpe import by_bytes
from tablesmith.llm.common import keep, text_of
from tablesmith.llm.words import hash_words, mix

SAMPLE_DOCS = 2_000
SAMPLE_CHARS = 8_000_000
CURVE_DOCS = 4_000
PARTS = 3  # of the labelled texts; the curve sees each through models of the others
STRETCHES = (8, 32)  # words
TELLING = (1, 3)  # words
WIDTH = 1 + len(STRETCHES) + len(TELLING)  # features
THRESHOLD = 0.3
_START, _UNSEEN = np.uint64(1), np.uint64(2)


def fold(id_col: str, folds: int) -> Column:
    """The remainder of crc32 of the id as text; null ids are in no fold."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def _part(id_col: str) -> Column:
    return F.pmod(F.shiftright(F.xxhash64(id_col), 20), F.lit(PARTS)).cast("int")


def _pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of all texts the word before it (a mark at the start), itself; and the texts' bounds."""
    words, bounds = hash_words([t.lower().encode() for t in texts], letters_only=True)
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[bounds[:-1][bounds[:-1] < len(words)]] = _START
    return before, words, bounds


def _pair_key(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + words)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The index of each wanted key in the sorted ``keys``, ``len(keys)`` where it is missing."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, len(keys))


def _discount(counts: np.ndarray) -> float:
    """The share of a count that goes to the backoff, from how many counts are one and two."""
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.9)


@dataclass
class ClassModels:
    """Tables of both classes (columns 0 ordinary, 1 toxic); the last row of ``pair_p`` is for missing pairs."""

    words: np.ndarray  # hashes, sorted; words not seen have one entry
    word_p: np.ndarray  # chance of a word, discounted and backed off to the shared one
    backoff: np.ndarray  # weight of that chance after a word
    pairs: np.ndarray  # keys, sorted
    pair_p: np.ndarray  # discounted chance of a word after another

    @staticmethod
    def fit(before: np.ndarray, words: np.ndarray, counts: np.ndarray) -> ClassModels:
        """From distinct pairs and the number of texts (n, 2) that hold them, of which one is not zero in each row.

        Kneser-Ney: a word's own chance comes from the number of different words before it.
        """
        known = np.unique(np.concatenate((np.unique(before), np.unique(words), [_START, _UNSEEN])))
        size = len(known)
        order = np.argsort(_pair_key(before, words))
        v, w, counts = np.searchsorted(known, before[order]), np.searchsorted(known, words[order]), counts[order]
        both = counts.sum(axis=1)
        either = np.bincount(w, minlength=size)
        shared = (either + 0.5) / (either.sum() + 0.5 * size)
        all_after = np.maximum(np.bincount(v, both, minlength=size), 1)
        kept = np.maximum(both - _discount(both), 0)
        shared_pair = kept / all_after[v]
        shared_backoff = 1 - np.bincount(v, kept, minlength=size) / all_after
        del both, kept, either
        word_p, backoff, pair_p = (np.zeros((n + 1, 2)) for n in (size, size, len(v)))
        for k in (0, 1):
            seen = counts[:, k] > 0
            own = np.bincount(w[seen], minlength=size)  # different words before each
            d, total = _discount(own[own > 0]), own.sum()
            word_p[:-1, k] = (np.maximum(own - d, 0) + d * (own > 0).sum() * shared) / total if total else shared
            kept = np.maximum(counts[:, k] - _discount(counts[seen, k]), 0)
            after = np.maximum(np.bincount(v, counts[:, k], minlength=size), 1)
            left = 1 - np.bincount(v, kept, minlength=size) / after
            pair_p[:-1, k] = kept / after[v] + left[v] * shared_pair
            backoff[:-1, k] = left * shared_backoff
        return ClassModels(known, word_p, backoff, _pair_key(known[v], known[w]), pair_p)

    def ratios(self, before: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log of the chances of each word, toxic over ordinary: after the word before it, and by itself."""
        w, v = ((np.where((at := _find(self.words, x)) < len(self.words), at, np.searchsorted(self.words, _UNSEEN))) for x in (words, before))
        p = self.pair_p[_find(self.pairs, _pair_key(self.words[v], self.words[w]))] + self.backoff[v] * self.word_p[w]
        return np.log(p[:, 1] / p[:, 0]), np.log(self.word_p[w, 1] / self.word_p[w, 0])

    def features(self, before: np.ndarray, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Of texts as ``_pairs`` gives them: the mean ratio, the largest mean over each length of stretch (shorter texts: their sum over it),
        and the mean of the largest ratios of so many different words by themselves."""
        pairs, alone = self.ratios(before, words)
        sums = np.concatenate(([0.0], np.cumsum(pairs)))
        out = np.zeros((len(bounds) - 1, WIDTH))
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if a < b:
                out[i, 0] = (sums[b] - sums[a]) / (b - a)
                for k, n in enumerate(STRETCHES):
                    out[i, k + 1] = ((sums[a + n : b + 1] - sums[a : b + 1 - n]).max() if b - a >= n else sums[b] - sums[a]) / n
                once = np.sort(alone[a:b][np.unique(words[a:b], return_index=True)[1]])
                for k, n in enumerate(TELLING):
                    out[i, k + 1 + len(STRETCHES)] = once[-n:].sum() / n
        return out


@dataclass
class Curve:
    """Logistic curve over scaled features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> Curve:
        """By Newton steps; with one class only, its share decides alone."""
        width = x.shape[1]
        if not len(y) or y.min() == y.max():
            share = float(y.mean()) if len(y) else 0.0
            return Curve(np.zeros(width), np.ones(width), np.append(np.zeros(width), 20.0 * share - 10.0))
        mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
        z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
        w = np.zeros(width + 1)
        damp = np.diag(np.append(np.full(width, ridge), 1e-6))
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + damp, z.T @ (y - p) - damp @ w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        return Curve(mean, scale, w)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1], -30, 30)
        return 1 / (1 + np.exp(-z))


def _scan(docs: DataFrame, schema: str, make) -> DataFrame:
    """``docs`` (first columns, ``text`` last) by groups of texts: ``make(columns but text, texts)``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for group in by_bytes((x.as_py() for x in batch.column(batch.num_columns - 1)), 1 << 20):
                yield make([c.slice(at, len(group)) for c in batch.columns[:-1]], group)
                at += len(group)

    return docs.mapInArrow(work, schema)


def _pair_counts(columns: list, texts: list[str]) -> pa.RecordBatch:
    before, words, bounds = _pairs(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    once = np.unique(np.stack((before.view(np.int64), words.view(np.int64), text)), axis=1)
    once[2] = columns[0].to_numpy()[once[2]]
    rows, counts = np.unique(once, axis=1, return_counts=True)
    n = [np.where(rows[2] == k, counts, 0) for k in range(2 * PARTS)]
    return pa.RecordBatch.from_arrays([*map(pa.array, rows[:2]), *(pa.array(c, pa.int64()) for c in n)], names=["before", "word", *(f"n{k}" for k in range(2 * PARTS))])


def train(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[ClassModels], Curve]:
    """Fit on labelled documents outside ``held_out``; the curve sees each part of them through models of the other parts.

    These models, one without each part, are the result: a new text looks to them as those of the curve did.

    A document with several labels is toxic if one says so; null labels and ids are left out. Rows
    repeated in full teach once, different texts of one id teach each.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id"))
    own = own.agg(F.max((F.col(label_col) > 0).cast("int")).alias("toxic")).where(~held_out)
    order = F.xxhash64("doc_id")
    # rows repeated in full are one document
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    ids = texts.groupBy("doc_id", F.xxhash64("text").alias("own")).agg(F.max(F.length("text")).alias("n"))
    own = keep(own.join(ids, "doc_id").select("doc_id", "toxic", "n", order.alias("order"), _part("doc_id").alias("part")), "labelled")

    def those(ids: list[tuple]) -> DataFrame:
        wanted = F.broadcast(docs.sparkSession.createDataFrame(ids, f"doc_id {kind}, toxic int"))
        return texts.join(wanted, "doc_id").groupBy("doc_id", "toxic", F.xxhash64("text").alias("own")).agg(F.first("text").alias("text"))

    chosen = []
    for toxic in (0, 1):
        room, fit = SAMPLE_CHARS, []
        for r in own.where(F.col("toxic") == toxic).orderBy("order", "doc_id").limit(SAMPLE_DOCS).collect():
            if r["n"] <= room:
                room -= r["n"]
                fit.append((r["doc_id"], toxic))
        chosen.append(fit)
    # as many texts of either class: the larger class is cut to the size of the smaller
    picked = sorted({row for pair in zip(*chosen) for row in pair})
    sample = those(picked)
    kinds = range(2 * PARTS)
    counted = _scan(sample.select((2 * _part("doc_id") + F.col("toxic")).alias("kind"), "text"), "before long, word long, " + ", ".join(f"n{k} long" for k in kinds), _pair_counts)
    table = counted.groupBy("before", "word").agg(*[F.sum(f"n{k}").cast("int").alias(f"n{k}") for k in kinds]).toArrow()
    before, words = (table.column(c).to_numpy().view(np.uint64) for c in ("before", "word"))
    counts = np.column_stack([table.column(f"n{k}").to_numpy() for k in kinds])
    del table

    def fit_without(part: int) -> ClassModels:
        n = np.column_stack([counts[:, [2 * k + c for k in range(PARTS) if k != part]].sum(axis=1) for c in (0, 1)])
        some = n.any(axis=1)
        return ClassModels.fit(before[some], words[some], n[some].astype(float))

    curve = sorted({(r["doc_id"], r["toxic"]) for r in own.orderBy("order", "doc_id").limit(CURVE_DOCS).collect()})
    sample = keep(those(curve), "curve-texts")
    x, y, models = [], [], []
    for part in range(PARTS):
        models.append(fit_without(part))
        shared = docs.sparkSession.sparkContext.broadcast(models[-1])
        rows = _features(sample.where(_part("doc_id") == part).select("toxic", "text"), "toxic int", shared).toArrow()
        shared.destroy()
        x += rows.column("x").to_pylist()
        y += rows.column("toxic").to_pylist()
    return models, Curve.fit(np.array(x, float).reshape(-1, WIDTH), np.array(y, float))


def _features(docs: DataFrame, head: str, shared: Broadcast) -> DataFrame:
    names = [*docs.columns[:-1], "x"]

    def make(columns: list, texts: list[str]) -> pa.RecordBatch:
        x = shared.value.features(*_pairs(texts))
        return pa.RecordBatch.from_arrays([*columns, pa.array(x.tolist(), pa.list_(pa.float64()))], names=names)

    return _scan(docs, f"{head}, x array<double>", make)


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` and ``ratio`` (mean log ratio a word) for each row.

    Documents of the fold ``held_out`` teach nothing. Only the text is scored: a null or empty one
    gets the score of no evidence. Without labels (or with one class) every score is alike.
    """
    models, curve = train(docs, labels, F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)), id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((models, curve))

    def make(columns: list, texts: list[str]) -> pa.RecordBatch:
        models, curve = shared.value
        pairs = _pairs(texts)
        x = np.stack([m.features(*pairs) for m in models])
        score = np.mean([curve.scores(own) for own in x], axis=0)
        return pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array(x[:, :, 0].mean(axis=0))], names=["doc_id", "held_out", "score", "ratio"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold(id_col, folds) == held_out, F.lit(False)).alias("held_out"), text_of(text_col).alias("text"))
    scored = _scan(rows, f"doc_id {kind}, held_out boolean, score double, ratio double", make)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "ratio")
