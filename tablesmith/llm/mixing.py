"""Log-probabilities of texts by online logistic mixing of hashed-context bit predictors.

A text is its lower-cased words and an end. Each is coded by binary decisions: the path of a
frequent word in a Huffman tree, or that of a mark for all others and then their bytes and a blank.
For each decision several predictors look up a context: how often the bit was set there, counted
over all training documents. One predictor is exact (the tree's own counts), the others are hashed
into tables of fixed size: the last very common word, the word before, the two words before; inside
spelled words the bytes before. Their log odds are mixed by weights that a gate (the depth of the
decision and how sure the longest context is) selects, and the result is refined by an adaptive map
from mixed odds to observed shares. All training documents fill the tables, and weights and map are learnt online
from all of them: a task predicts each group of its texts by what it counted in the groups before,
learns from what came, then counts the group. Weights are averaged over tasks by how often a gate
was passed, the observations of the map added up. While a text is scored, a correction of its own
is learnt online, block by block. The probabilities of all possible texts add up to one.

What is broadcast has a fixed size: ``FREQUENT`` words and ``2**TABLE_LOG2`` slots for each table.
Counts of words that are not frequent never leave Spark: their occurrences are joined to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.bpe import by_bytes
from tablesmith.llm.common import keep, row_key, text_of
from tablesmith.llm.toxicity import fold
from tablesmith.llm.words import mix, spelled_words

FREQUENT = 1 << 19  # words with a path of their own
LEAST = 3  # a word found less often is spelled
COMMON = 64  # words that stand for the language and style around
TABLE_LOG2 = 20
TABLES = 3  # for words, and as many for spelling
GROUP_CHARS = 1 << 19
FIRST_CHARS = 1 << 12  # the first group a task learns from; the next are as long as all before
CHUNK = 1 << 14  # words expanded at once
BLOCK = 2048  # decisions between corrections
STEP = 8192  # decisions between steps of the weights
RATE, OWN_RATE = 0.002, 1.0
MOST = 0.05  # a weight moves by so much in a step at most, so that one long monotonous text does not carry it away
END, OTHER = 0, 1  # symbols before the frequent words
_DEPTHS, _SURE, _BINS = 24, 4, 33
_WORD_GATES = _DEPTHS * _SURE
_GATES = _WORD_GATES + 8 * _SURE
_M = np.random.default_rng(30).integers(1, 2**62, 16, np.uint64) * np.uint64(2) + np.uint64(1)
_PAD = 5
_LEARNT = -1  # the piece that holds weights and map
_MARK = np.uint32(0x9E3779B1)
# by byte and bit of it: the mark of the bits before, and the bit
_PLACE = np.arange(8)
_BYTE = np.arange(256)[:, None]
_BYTE_MARKS = ((1 << _PLACE) | (_BYTE >> (8 - _PLACE))).astype(np.uint32) * _MARK
_BYTE_BITS = ((_BYTE >> (7 - _PLACE)) & 1).astype(np.int8)
_BYTE_GATES = ((_DEPTHS + _PLACE) * _SURE).astype(np.uint8)


@dataclass
class Code:
    """A canonical Huffman code of END, OTHER and the frequent words, with the odds at its nodes."""

    words: np.ndarray  # hashes, sorted
    counts: np.ndarray  # of each word
    code: np.ndarray  # by symbol
    length: np.ndarray
    base: np.ndarray  # by depth: what makes a prefix the number of its node
    odds: np.ndarray  # by node: log odds of a set bit
    common: np.ndarray  # by symbol: 1 to COMMON for the most frequent words, else 0

    @staticmethod
    def make(words: np.ndarray, counts: np.ndarray, ends: int, others: int) -> Code:
        order = np.argsort(words)
        words, counts = words[order], counts[order]
        weight = np.concatenate(([max(ends, 1), max(others, 1)], counts)).astype(np.float64)
        length = _code_lengths(weight)
        rank = np.lexsort((np.arange(len(weight)), length))
        deepest = int(length.max())
        leaves = np.bincount(length, minlength=deepest + 1)
        first = np.zeros(deepest + 2, np.int64)
        for d in range(1, deepest + 1):
            first[d] = (first[d - 1] + leaves[d - 1]) << 1 if d > 1 else 0
        start = np.cumsum(leaves) - leaves
        code = np.zeros(len(weight), np.int64)
        code[rank] = first[length[rank]] + np.arange(len(weight)) - start[length[rank]]
        # nodes of depth d have prefixes from first + leaves on
        begins = first[: deepest + 1] + leaves
        inner = np.zeros(deepest + 1, np.int64)
        inner[0] = 1 if deepest else 0
        for d in range(1, deepest + 1):
            inner[d] = 2 * inner[d - 1] - leaves[d]
        offset = np.cumsum(inner) - inner
        base = offset - begins
        odds = np.zeros(int(inner.sum()) + 1, np.float32)
        below = np.zeros(0)
        by_rank = weight[rank]
        for d in range(deepest - 1, -1, -1):
            children = np.concatenate((by_rank[start[d + 1] : start[d + 1] + leaves[d + 1]], below))
            pair = children.reshape(-1, 2)
            odds[offset[d] : offset[d] + inner[d]] = np.log(pair[:, 1] / pair[:, 0])
            below = pair.sum(axis=1)
        common = np.zeros(len(weight), np.int64)
        top = np.argsort(-weight[2:], kind="stable")[:COMMON] + 2
        common[top] = np.arange(1, len(top) + 1)
        kind = np.int32 if deepest < 31 else np.int64
        return Code(words, counts, code.astype(kind), length.astype(np.int32), base.astype(kind), odds, common)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol and the training count of each word, OTHER and -1 for those not frequent."""
        if not len(self.words):
            return np.full(len(hashes), OTHER), np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        hit = self.words[at] == hashes
        return np.where(hit, at + 2, OTHER), np.where(hit, self.counts[at], -1)


def _code_lengths(weight: np.ndarray) -> np.ndarray:
    """Huffman code lengths, by merging two sorted queues."""
    n = len(weight)
    order = np.argsort(weight, kind="stable")
    leaf = weight[order].tolist()
    made: list[float] = []
    parent = [0] * (2 * n - 1)
    i = j = 0
    for k in range(n - 1):
        total = 0.0
        for _ in range(2):
            if i < n and (j >= len(made) or leaf[i] <= made[j]):
                total += leaf[i]
                parent[i] = n + k
                i += 1
            else:
                total += made[j]
                parent[n + j] = n + k
                j += 1
        made.append(total)
    depth = [0] * (2 * n - 1)
    for k in range(2 * n - 3, -1, -1):
        depth[k] = depth[parent[k]] + 1
    out = np.zeros(n, np.int64)
    out[order] = depth[:n]
    return out


@dataclass
class Decisions:
    """Binary decisions in order: bit, first gate of its depth, exact odds (words only) and table slots; ``text`` begins at ``first``."""

    text: np.ndarray
    first: np.ndarray
    bit: np.ndarray
    gate: np.ndarray
    exact: np.ndarray | None
    slots: list[np.ndarray]

    @property
    def first_table(self) -> int:
        return 0 if self.exact is not None else TABLES


class Texts:
    """The words of a group of texts, with an end after each text."""

    def __init__(self, code: Code, texts: list[bytes]):
        self.code = code
        words, bounds, self.data, starts, ends = spelled_words([t.lower() for t in texts])
        n, k = len(words), len(texts)
        symbol, count = code.find(words)
        place = np.arange(n) + np.repeat(np.arange(k), np.diff(bounds))
        stops = bounds[1:] + np.arange(k)
        self.bounds = np.append(0, stops + 1)
        size = n + k
        self.symbol, self.count, self.hash = np.full(size, END), np.full(size, -1), np.zeros(size, np.uint64)
        self.symbol[place], self.count[place], self.hash[place] = symbol, count, words
        self.start, self.stop = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.start[place], self.stop[place] = starts, ends
        self.text = np.repeat(np.arange(k), np.diff(self.bounds))
        first = self.bounds[:-1][self.text]
        at = np.arange(size)
        one = np.where(at > first, np.append(np.uint64(0), self.hash[:-1]), np.uint64(1))
        two = np.where(at > first + 1, np.append(np.zeros(2, np.uint64), self.hash)[:size], np.uint64(2))
        common = code.common[self.symbol]
        last = np.maximum.accumulate(np.where(common > 0, at, -1))
        last = np.append(-1, last[:-1])
        self.common = np.where(last >= first, common[np.maximum(last, 0)], 0).astype(np.uint64)
        self.contexts = [_half(mix(x)) for x in (self.common + _M[0], one + _M[1], one * _M[2] + two + _M[3])]

    def all_decisions(self) -> Iterator[Decisions]:
        for a in range(0, len(self.symbol), CHUNK):
            yield from self.decisions(a, min(a + CHUNK, len(self.symbol)))

    def decisions(self, a: int, b: int) -> Iterator[Decisions]:
        """Those of the words ``a`` to ``b``: paths in the tree, then spellings."""
        code, symbol = self.code, self.symbol[a:b]
        length = code.length.take(symbol)
        stop = np.cumsum(length, dtype=np.int32)
        after = np.repeat(stop, length) - np.arange(1, stop[-1] + 1, dtype=np.int32)
        path = np.repeat(code.code.take(symbol), length) >> after
        depth = np.repeat(length - 1, length) - after
        node = (path >> 1) + code.base.take(depth)
        mark = node.astype(np.uint32) * _MARK
        slots = [_slot(np.repeat(c[a:b], length) + mark) for c in self.contexts]
        gate = (np.minimum(depth, _DEPTHS - 1) * _SURE).astype(np.uint8)
        yield Decisions(*self._texts(np.arange(a, b), stop), (path & 1).astype(np.int8), gate, code.odds.take(node), slots)
        other = np.flatnonzero(symbol == OTHER) + a
        if len(other):
            yield self._spelling(other)

    def _texts(self, words: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts that ``words`` are of, and where the decisions of each begin; those of a word end at ``stop``."""
        text = self.text[words]
        new = np.flatnonzero(np.diff(text, prepend=-1))
        return text[new], np.append(0, stop)[new]

    def _spelling(self, other: np.ndarray) -> Decisions:
        size = self.stop[other] - self.start[other] + 1
        stop = np.cumsum(size)
        word = np.repeat(np.arange(len(other)), size)
        inside = np.arange(len(word)) - np.repeat(stop - size, size)
        byte = np.where(inside < size[word] - 1, self.data[np.minimum(self.start[other][word] + inside, len(self.data) - 1)], 0x20).astype(np.uint64)
        before, back = np.zeros(len(word), np.uint64), []
        for k in range(1, _PAD + 1):
            shifted = np.append(np.full(k, 0x20, np.uint64), byte)[: len(byte)]
            before = before << np.uint64(8) | np.where(inside >= k, shifted, np.uint64(0x20))
            back.append(before)
        style = self.common[other][word] * _M[6]
        contexts = [_half(mix(x)) for x in (back[1] + style + _M[7], back[2] + _M[8], back[4] + style + _M[9])]
        value = byte.astype(np.intp)
        mark = _BYTE_MARKS.take(value, axis=0)
        slots = [_slot((c[:, None] + mark).reshape(-1)) for c in contexts]
        return Decisions(*self._texts(other, stop * 8), _BYTE_BITS.take(value, axis=0).reshape(-1), np.tile(_BYTE_GATES, len(value)), None, slots)


def _half(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(32)).astype(np.uint32)


def _slot(x: np.ndarray) -> np.ndarray:
    """A place in a table, from all bits of a context and node (overwritten)."""
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    x >>= np.uint32(32 - TABLE_LOG2)
    return x.astype(np.intp)


@dataclass
class Model:
    code: Code
    tables: np.ndarray  # (2 * TABLES, slots) log odds times 16: of words, then of spelling
    weights: np.ndarray  # (gates, 1 + TABLES)
    refined: np.ndarray  # (gates * bins) shares of set bits

    def inputs(self, d: Decisions) -> tuple[np.ndarray, np.ndarray]:
        """Log odds by decision and predictor, and the gate of each decision."""
        x = np.empty((len(d.bit), 1 + TABLES), np.float32)
        x[:, 0] = 0.3 if d.exact is None else d.exact
        for k, slot in enumerate(d.slots):
            entry = self.tables[d.first_table + k].take(slot, mode="clip")
            np.multiply(entry, np.float32(1 / 16), out=x[:, k + 1])
        # how sure the longest context is: 0 to 3 from |log odds|
        entry = np.abs(entry)
        gate = d.gate.copy()
        for least in (0.5, 1.5, 3):
            gate += entry > np.int8(16 * least)
        return x, gate.astype(np.intp)

    def costs(self, d: Decisions, own: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each bit; ``own`` (text, kind, weights) are corrections, learnt on the way."""
        x, gate = self.inputs(d)
        z = _mixed(x, self.weights, gate)
        p, bit = np.empty_like(z), d.bit.astype(np.float32)
        kind, first = int(d.exact is None), d.first.tolist()
        for text, a, b in zip(d.text.tolist(), first, [*first[1:], len(z)]):
            mine = own[text, kind]
            for i in range(a, b, BLOCK):
                part = slice(i, min(i + BLOCK, b))
                if np.count_nonzero(mine):
                    z[part] += x[part] @ mine
                    _bound(z[part], 20)
                mine += np.float32(OWN_RATE / BLOCK) * ((bit[part] - _squash(z[part], p[part])) @ x[part])
        p += self.refined.take(gate * _BINS + _bin(z), mode="clip")
        p *= np.float32(0.5)
        p -= 1 - bit  # now p where the bit is set, else p - 1
        return np.log(np.abs(p, out=p), out=p)

    def scores(self, texts: list[bytes]) -> tuple[Texts, np.ndarray]:
        """The words, and each text's log10 probability."""
        parsed = Texts(self.code, texts)
        out = np.zeros(len(texts))
        own = np.zeros((len(texts), 2, 1 + TABLES), np.float32)
        for d in parsed.all_decisions():
            out[d.text] += np.add.reduceat(self.costs(d, own), d.first, dtype=np.float64)
        return parsed, out / np.log(10)


def _mixed(x: np.ndarray, weights: np.ndarray, gate: np.ndarray) -> np.ndarray:
    part = weights.take(gate, axis=0, mode="clip")
    part *= x
    z = part[:, 0].copy()  # a product of matrices this large would start threads
    for k in range(1, part.shape[1]):
        z += part[:, k]
    return _bound(z, 20)


def _bound(z: np.ndarray, most: float) -> np.ndarray:
    return np.clip(z, np.float32(-most), np.float32(most), out=z)


def _squash(z: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Shares between 1e-5 and 1 - 1e-5."""
    p = np.clip(z, _LEAST, -_LEAST, out=out)
    np.exp(np.negative(p, out=p), out=p)
    p += 1
    return np.reciprocal(p, out=p)


def _bin(z: np.ndarray) -> np.ndarray:
    twice = _bound(z * np.float32(2), 16)
    twice += 16
    return np.rint(twice, out=twice).astype(np.intp)


_LEAST = np.float32(np.log(1e-5 / (1 - 1e-5)))
_CENTRE = 1 / (1 + np.exp(-(np.arange(_BINS) - 16) / 2))


class Lessons:
    """Weights as they are learnt online, and how often the map saw each bit."""

    def __init__(self):
        self.weights = np.full((_GATES, 1 + TABLES), 0.25, np.float32)
        self.weights[:, 0] = 0.5
        self.seen = np.zeros(_GATES * _BINS * 2)

    def learn(self, d: Decisions, model: Model) -> None:
        """One step for every ``STEP`` decisions; the map sees odds as they were before the step."""
        x, gate = model.inputs(d)
        bit = d.bit.astype(np.float32)
        z = np.empty(len(gate), np.float32)
        for i in range(0, len(gate), STEP):
            part = slice(i, i + STEP)
            z[part] = _mixed(x[part], self.weights, gate[part])
            wrong = (bit[part] - _squash(z[part])) * np.float32(RATE)
            for k in range(1 + TABLES):
                step = np.bincount(gate[part], wrong * x[part, k], minlength=_GATES)
                self.weights[:, k] += np.clip(step, -MOST, MOST)
        self.seen += np.bincount((gate * _BINS + _bin(z)) * 2 + d.bit, minlength=len(self.seen))

    def sums(self) -> np.ndarray:
        """Numbers that may be added to those of other tasks."""
        passed = self.seen.reshape(_GATES, -1).sum(axis=1)
        return np.concatenate(((self.weights * passed[:, None]).reshape(-1), self.seen))

    @staticmethod
    def model(code: Code, tables: np.ndarray, sums: np.ndarray) -> Model:
        """The averaged weights (those of gates never passed as at the start) and the map."""
        start = Lessons().weights
        total, seen = sums[: start.size].reshape(start.shape), sums[start.size :].reshape(_GATES, _BINS, 2)
        passed = seen.sum(axis=(1, 2))[:, None]
        weights = np.where(passed > 0, total / np.maximum(passed, 1), start).astype(np.float32)
        shares = (seen[..., 1] + 20 * _CENTRE) / (seen.sum(axis=2) + 20)
        return Model(code, tables, weights, np.clip(shares, 1e-5, 1 - 1e-5).astype(np.float32).reshape(-1))


def learn(code: Code, tables: np.ndarray, texts: list[bytes]) -> Model:
    """Weights and map by one online pass over ``texts`` in order, with tables that are there already."""
    lessons = Lessons()
    before = Model(code, tables, lessons.weights, np.zeros(0, np.float32))
    for group in by_bytes(texts, GROUP_CHARS):
        for d in Texts(code, group).all_decisions():
            lessons.learn(d, before)
    return Lessons.model(code, tables, lessons.sums())


def _odds(counts: np.ndarray) -> np.ndarray:
    """Table entries, log odds times 16, from how often each bit was not set and set (last axis)."""
    n = counts.astype(np.float32) + np.float32(0.4)
    return np.clip(np.rint(16 * np.log(n[..., 1] / n[..., 0])), -127, 127).astype(np.int8)


def _growing(texts: Iterator[str]) -> Iterator[list[str]]:
    """Texts in groups that are as long as all before, within bounds; a longer text is a group of its own."""
    group, size, limit = [], 0, FIRST_CHARS
    for t in texts:
        if group and size + len(t) > limit:
            yield group
            limit = min(limit + size, GROUP_CHARS)
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


class Counts:
    """Tables of counts that grow text by text, and the lessons drawn before a text is counted.

    The entries that predict are renewed whenever the counted decisions have doubled.
    """

    def __init__(self, code: Code):
        self.code, self.lessons = code, Lessons()
        self.total = np.zeros((2 * TABLES, 1 << TABLE_LOG2, 2), np.int32)
        self.so_far = Model(code, np.zeros((2 * TABLES, 1 << TABLE_LOG2), np.int8), self.lessons.weights, np.zeros(0, np.float32))
        self.n = self.renewed = 0

    def add(self, texts: list[bytes]) -> None:
        one = np.int32(1)  # a typed one adds far faster
        if self.n > 2 * self.renewed:
            for k, counts in enumerate(self.total):
                self.so_far.tables[k] = _odds(counts)
            self.renewed = self.n
        for d in Texts(self.code, texts).all_decisions():
            self.lessons.learn(d, self.so_far)
            for k, slot in enumerate(d.slots):
                np.add.at(self.total[d.first_table + k].reshape(-1), slot * 2 + d.bit, one)
            self.n += len(d.bit)


def _texts(docs: DataFrame, schema: str, make) -> DataFrame:
    """``docs`` (``text`` last) by groups: ``make(other columns, texts as bytes)`` gives batches."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for group in by_bytes((x.as_py() for x in batch.column(batch.num_columns - 1)), GROUP_CHARS):
                yield from make([c.slice(at, len(group)) for c in batch.columns[:-1]], [t.encode() for t in group])
                at += len(group)

    return docs.mapInArrow(work, schema)


def _word_counts(columns: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    words = spelled_words([t.lower() for t in texts])[0]
    values, counts = np.unique(words.view(np.int64), return_counts=True)
    yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts.astype(np.int64))], names=["word", "n"])


def _model(train: DataFrame, code: Code) -> Model:
    """Tables, weights and map from the decisions of all training documents (``text``).

    Each task adds up whole tables and sends them on in pieces; sums of a piece meet in one task.
    """
    shared = train.sparkSession.sparkContext.broadcast(code)
    piece = 1 << 14

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(shared.value)
        for group in _growing(x.as_py() for batch in batches for x in batch.column(0)):
            counts.add([t.encode() for t in group])
        flat = counts.total.reshape(-1, 2 * piece)
        some = np.flatnonzero(flat.any(axis=1))
        parts = [(_LEARNT, counts.lessons.sums()), *((int(j), flat[j]) for j in some)]
        for i in range(0, len(parts), 64):
            at, data = zip(*parts[i : i + 64])
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([x.tobytes() for x in data], pa.binary())], names=["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(data.as_buffer(), np.float64 if at == _LEARNT else np.int32)
                sums[at] = sums[at] + part if at in sums else part.astype(part.dtype if at == _LEARNT else np.int64)
        for at, both in sums.items():
            data = both if at == _LEARNT else _odds(both.reshape(-1, 2))
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([data.tobytes()], pa.binary())], names=["piece", "odds"])

    parts = train.select("text").mapInArrow(count, "piece long, counts binary").repartition("piece")
    tables, learnt = np.zeros((2 * TABLES, 1 << TABLE_LOG2), np.int8), Lessons().sums()
    for row in parts.mapInArrow(add, "piece long, odds binary").toArrow().to_pylist():
        if row["piece"] == _LEARNT:
            learnt = np.frombuffer(row["odds"], np.float64)
        else:
            tables.reshape(-1, piece)[row["piece"]] = np.frombuffer(row["odds"], np.int8)
    return Lessons.model(code, tables, learnt)


def score_documents(docs: DataFrame, folds: int = 7, held_out: int = 2, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and ``bits_per_byte`` for each row.

    Documents of the fold ``held_out`` (null ids are in none) teach nothing. ``base_score`` is the
    add-one word model's log10 probability, ``score`` the mixed model's. A null or empty text is an
    end alone. Rows repeated in full teach and are scored each.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        row_key(id_col, text_col).alias("key"), F.col(id_col).alias("doc_id"), F.coalesce(fold(id_col, folds) == held_out, F.lit(False)).alias("held_out"), text_of(text_col).alias("text")
    )
    train = rows.where(~F.col("held_out")).select("text")
    counted = _texts(train, "word long, n long", _word_counts).groupBy("word").agg(F.sum("n").alias("n"))
    counted = keep(counted, "word-counts")
    facts = counted.agg(F.count(F.lit(1)).alias("kinds"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    n_docs = train.count()
    total, kinds = facts["n"] + n_docs, facts["kinds"] + (n_docs > 0)
    # the most frequent words, as many whole counts as fit the bound
    least = LEAST
    if facts["kinds"] > frequent:
        by_count, room = counted.groupBy("n").count().orderBy(F.desc("n")).limit(frequent).collect(), frequent
        for r in by_count:
            if r["count"] > room:
                break
            least, room = max(r["n"], LEAST), room - r["count"]
    top = counted.where(F.col("n") >= least).toArrow()
    words, counts = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    code = Code.make(words, counts, n_docs, facts["n"] - int(counts.sum()))

    # whole partitions are put together, so that the tables sent grow with the input and stay few
    model = _model(train.coalesce(max(1, train.rdd.getNumPartitions() // 4)), code)
    shared = spark.sparkContext.broadcast(model)

    def make(columns: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        parsed, score = shared.value.scores(texts)
        size, known = np.diff(parsed.bounds), parsed.count >= 0
        sums = lambda x: np.add.reduceat(x, parsed.bounds[:-1])
        ended = (parsed.symbol == END).astype(np.int64)
        own = sums(np.where(known, np.log10(np.maximum(parsed.count, 0) + 1.0), 0.0))
        cols = [pa.array(x) for x in (size, sums(known.astype(np.int64)), own, score, np.array([len(t) for t in texts]))]
        nothing = [pa.nulls(len(texts), pa.int64())] * 2
        yield pa.RecordBatch.from_arrays([*columns, *cols, *nothing], names=names)
        other = np.flatnonzero(~known & (ended == 0))
        if len(other):  # a row for each word that is not frequent, to be joined to its count
            pair, n = np.unique(np.stack((parsed.text[other], parsed.hash[other].view(np.int64))), axis=1, return_counts=True)
            picked = [c.take(pa.array(pair[0])) for c in columns]
            nothing = [pa.nulls(len(n), t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*picked, *nothing, pa.array(pair[1]), pa.array(n)], names=names)

    names = ["key", "doc_id", "held_out", "n_tokens", "n_known", "own", "score", "n_bytes", "word", "times"]
    schema = f"key struct<a:long,b:long>, doc_id {kind}, held_out boolean, n_tokens long, n_known long, own double, score double, n_bytes long, word long, times long"
    scored = keep(_texts(rows, schema, make), "scored")
    # one row for each document and word: rows repeated in full say the same
    others = scored.where("word IS NOT NULL").select("key", "word", "times").distinct()
    others = others.join(counted, "word").groupBy("key").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("times").alias("found"))
    joined = scored.where("word IS NULL").join(others, "key", "left")
    n_known = F.col("n_known") + F.coalesce("found", F.lit(0)) + F.lit(int(n_docs > 0))
    gained = F.col("own") + F.coalesce("more", F.lit(0.0)) + F.log10(F.lit(n_docs + 1.0))
    return joined.select(
        "doc_id", "held_out", "n_tokens", n_known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (gained - F.col("n_tokens") * F.log10(F.lit(float(total + kinds + 1)))).alias("base_score"), "score",
        (-F.col("score") * float(np.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
