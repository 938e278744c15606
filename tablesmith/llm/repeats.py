"""Remove later occurrences of word windows that repeat, by level-wise doubling.

A window is tried at a quarter of its length, then at half, then whole, and only what repeats at one
length is looked at in the next. The quarters are sampled without loss: a window is represented by
the quarter of least hash in it, the rightmost among equals, so equal windows show equal quarters at
equal places, and about one place in eight is listed. A quarter that repeats is extended to the half
beside it, to the right if that stays in the window and else to the left. Consecutive windows that
share a half's place form a run. Where a half repeats, runs are compared whole first: of equal runs
the earliest stays and the others go without a look inside. Only where one half has several runs are
the windows of the earliest of each compared one by one.

The levels are aggregates by hash that combine before the shuffle, so neither a passage in a third of
all documents nor a document repeated many times is gathered anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.anchors import grouped
from tablesmith.llm.common import row_key, text_of
from tablesmith.llm.decontam import bloom_filter, in_bloom
from tablesmith.llm.words import hash_words, mix
from tablesmith.session import scratch_tables, stored

SIZE = 20  # words of a window
GROUP_BYTES = 1 << 19  # text whose words are hashed at once
_PLACES = np.uint64(32)  # quarters are ordered by the upper 32 bits of their hash, then by place
_LEFT = np.uint64(0x9E3779B97F4A7C15)


def levels(size: int) -> tuple[int, int, int]:
    """The lengths tried: each at most twice the one before."""
    quarter = -(-size // 4)
    return quarter, min(2 * quarter, size), size


def _longer(hashes: np.ndarray, length: int, wanted: int) -> np.ndarray:
    """Hashes of windows of ``wanted`` items from those of ``length``, at most twice as long."""
    step = wanted - length
    n = max(len(hashes) - step, 0)
    return mix(hashes[:n] * _LEFT + mix(hashes[step : step + n] + np.uint64(wanted)))


def runs(words: np.ndarray, bounds: np.ndarray, size: int = SIZE) -> dict[str, np.ndarray]:
    """The runs of windows of all texts: ``text``, ``first`` (window, over all texts), ``count``, ``place`` (of the
    quarter) and the hashes ``quarter``, ``half`` and ``content`` (of all the run's words); ``window`` has one hash for each window."""
    none = np.zeros(0, np.int64)
    n = len(words) - size + 1
    if n <= 0:
        return {k: none for k in ("text", "first", "count", "place")} | {k: none.astype(np.uint64) for k in ("quarter", "half", "content", "window")}
    q, d, _ = levels(size)
    quarter = mix(words[: len(words) - q + 1] + np.uint64(q))
    for j in range(1, q):
        quarter = mix(quarter + words[j : len(words) - q + 1 + j])
    half = _longer(quarter, q, d)
    window = _longer(half, d, size)
    key = (quarter >> _PLACES << _PLACES) | (np.uint64((1 << 32) - 1) - np.arange(len(quarter), dtype=np.uint64))
    span, width = size - q + 1, 1
    while 2 * width <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if span > width:
        key = np.minimum(key[: width - span], key[span - width :])
    place = (np.uint64((1 << 32) - 1) - (key & np.uint64((1 << 32) - 1))).astype(np.int64)
    left = place - np.arange(n) > size - d
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = text[:n] == text[size - 1 :]
    fresh = np.ones(n, bool)
    fresh[1:] = (place[1:] != place[:-1]) | (left[1:] != left[:-1]) | ~inside[:-1]
    first = np.flatnonzero(fresh & inside)
    stop = np.append(np.flatnonzero(fresh | ~inside), n)
    count = stop[np.searchsorted(stop, first, side="right")] - first
    at, side = place[first], left[first]
    # a run has at most as many windows as a window has words: its ends cover it
    content = mix(window[first] * _LEFT + mix(window[first + count - 1] + count.astype(np.uint64)))
    return {
        "text": text[first], "first": first, "count": count, "place": at, "quarter": quarter[at],
        "half": mix(half[np.where(side, at - (d - q), at)] + _LEFT * side.astype(np.uint64)), "content": content, "window": window,
    }


def _scan(rows: DataFrame, schema: str, size: int, pick: Callable, bloom: np.ndarray | None = None) -> DataFrame:
    """The batches that ``pick(found, ids, marks, starts, bloom)`` makes of the runs of each group of texts."""
    shared = None if bloom is None else rows.sparkSession.sparkContext.broadcast(bloom)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_buffer().to_pybytes() for x in batch.column(2)]
            for at, data, ends in grouped(texts, GROUP_BYTES):
                begin = np.append(0, ends[:-1])
                words, bounds = hash_words([data[a:b] for a, b in zip(begin, ends)])
                found = runs(words, bounds, size)
                row = found["text"] + at
                yield pick(found, batch.column(0).take(pa.array(row)), batch.column(1).to_numpy()[row], found["first"] - bounds[found["text"]], shared and shared.value)

    return rows.mapInArrow(work, schema)


def _quarters(found: dict, ids, marks, starts, bloom) -> pa.RecordBatch:
    # a place with a left and a right run counts once
    fresh = np.append(True, found["place"][1:] != found["place"][:-1])[: len(starts)]
    seeds, n = np.unique(found["quarter"][fresh].view(np.int64), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(seeds), pa.array(n.astype(np.int64))], names=["seed", "n"])


def _halves(found: dict, ids, marks, starts, bloom) -> pa.RecordBatch:
    hit = np.flatnonzero(in_bloom(bloom, found["quarter"]))
    hashes = [pa.array(found[c][hit].view(np.int64)) for c in ("quarter", "half", "content")]
    return pa.RecordBatch.from_arrays(
        [*hashes, ids.take(pa.array(hit)), pa.array(marks[hit]), pa.array(starts[hit]), pa.array(found["count"][hit].astype(np.int32))],
        names=["seed", "half", "content", "doc_id", "mark", "start", "n"],
    )


def _windows(found: dict, ids, marks, starts, bloom) -> pa.RecordBatch:
    hit = np.flatnonzero(in_bloom(bloom, mix(marks.view(np.uint64) + starts.astype(np.uint64))))
    count = found["count"][hit]
    run = np.repeat(hit, count)
    step = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    return pa.RecordBatch.from_arrays(
        [pa.array(found["half"][run].view(np.int64)), pa.array(found["window"][found["first"][run] + step].view(np.int64)),
         ids.take(pa.array(run)), pa.array(marks[run]), pa.array(starts[run]), pa.array((starts[run] + step))],
        names=["half", "window", "doc_id", "mark", "run", "start"],
    )


def repeated_spans(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``mark`` (tells rows of one id apart), ``start``, ``stop``: spans of words to remove, which may overlap.

    They are written to the shared folder; the tables they are found with are deleted.
    """
    if size < 1:
        raise ValueError("a window has at least one word")
    with scratch_tables(docs.sparkSession) as keep:
        return stored(_spans(docs, size, keep, id_col, text_col), "word-spans")


def _spans(docs: DataFrame, size: int, keep, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    key = row_key(id_col, text_col)["a"].alias("mark")
    rows = docs.select(F.col(id_col).alias("doc_id"), key, F.encode(text_of(text_col), "UTF-8").alias("bytes"))
    at = F.struct("doc_id", "mark", "start")
    nothing = docs.sparkSession.createDataFrame([], f"doc_id {kind}, mark long, start long, stop long")

    # a quarter: sampled places whose words occur twice
    listed = _scan(rows, "seed long, n long", size, _quarters).groupBy("seed").agg(F.sum("n").alias("n"))
    twice = keep(listed.where("n > 1").select("seed"), "quarters")
    n = twice.count()
    if not n:
        return nothing

    # half: the filter lets few others through, which the join drops
    found = _scan(rows, f"seed long, half long, content long, doc_id {kind}, mark long, start long, n int", size, _halves, bloom_filter(twice, n))
    found = keep(found.join(twice, "seed", "left_semi").drop("seed"), "halves")
    each = keep(found.groupBy("half", "content").agg(F.min(at).alias("first"), F.max(at).alias("last")), "runs")

    # whole: equal runs, then the windows of the runs that share a half and differ
    copies = each.where("last > first").select("half", "content", "first")
    removed = found.join(copies, ["half", "content"]).where(at > F.col("first"))
    removed = removed.select("doc_id", "mark", "start", (F.col("start") + F.col("n") + (size - 1)).alias("stop"))
    several = each.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half")
    contested = each.join(several, "half").select("half", F.col("first.mark").alias("mark"), F.col("first.start").alias("run"))
    contested = keep(contested, "contested")
    n = contested.count()
    if not n:
        return removed
    seeds = _places(contested)
    one_by_one = _scan(rows, f"half long, window long, doc_id {kind}, mark long, run long, start long", size, _windows, bloom_filter(seeds, seeds.count()))
    one_by_one = keep(one_by_one.join(contested, ["half", "mark", "run"], "left_semi"), "windows")
    first = one_by_one.groupBy("half", "window").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("last > first").drop("last")
    later = one_by_one.join(first, ["half", "window"]).where(at > F.col("first"))
    return removed.unionByName(later.select("doc_id", "mark", "start", (F.col("start") + size).alias("stop")))


def _places(contested: DataFrame) -> DataFrame:
    """The hash of each place, as ``_windows`` takes it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mark, run = (batch.column(i).to_numpy().astype(np.int64).view(np.uint64) for i in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(mix(mark + run).view(np.int64))], names=["seed"])

    return contested.select("mark", "run").mapInArrow(work, "seed long")


def remove_repeated_windows(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept`` (unless off) and ``kept_sha256`` for each row.

    Words are what ASCII white space separates, unchanged; kept words are joined by one space. Removed
    is each word that a window of ``size`` words covers whose words also begin earlier: in a document
    of lesser id (null ids come first, rows of one id in the order of a hash of their text) or earlier
    in the same one. Windows are judged on the input and never cross documents. Rows repeated in full
    are one document and get the same answer. A null or empty text has no words; a text of fewer words
    than a window stays. Extra columns are not looked at.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    spans = repeated_spans(docs, size, id_col, text_col)
    pair = F.struct(F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))
    by_doc = spans.groupBy("doc_id", "mark").agg(F.collect_set(pair).alias("s"))
    by_doc = by_doc.select(F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark"), F.col("s.start").alias("starts"), F.col("s.stop").alias("stops"))
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col)["a"].alias("mark"), F.encode(text_of(text_col), "UTF-8").alias("bytes"))
    joined = rows.join(by_doc, (rows["mark"] == by_doc["of_mark"]) & rows["doc_id"].eqNullSafe(by_doc["of_id"]), "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, texts, shas = [], [], [], []
            for data, starts, stops in zip(batch.column(1), batch.column(2), batch.column(3)):
                words = data.as_buffer().to_pybytes().split()
                gone = 0
                if starts.is_valid:
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, starts.values.to_numpy(), 1)
                    np.add.at(cover, stops.values.to_numpy(), -1)
                    stays = np.cumsum(cover[:-1]) == 0
                    gone = int(len(words) - stays.sum())
                    kept = b" ".join([w for w, s in zip(words, stays.tolist()) if s])
                else:
                    kept = b" ".join(words)
                total.append(len(words))
                removed.append(gone)
                shas.append(hashlib.sha256(kept).hexdigest())
                if with_kept:
                    texts.append(kept.decode())
            cols = [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(texts, pa.string())] if with_kept else []), pa.array(shas, pa.string())], names=names)

    names = ["doc_id", "n_words", "n_removed", *(["kept"] if with_kept else []), "kept_sha256"]
    schema = f"doc_id {kind}, n_words long, n_removed long, {'kept string, ' if with_kept else ''}kept_sha256 string"
    return joined.select("doc_id", "bytes", "starts", "stops").mapInArrow(work, schema)
