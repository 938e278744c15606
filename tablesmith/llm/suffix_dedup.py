"""Remove the later occurrences of byte strings that repeat, by difference-cover suffix sorting.

What has to be sorted is found first. Texts are cut into content-defined regions (see ``anchors``):
windows of ``SIZE`` bytes can only be equal in regions with equal anchors. A region whose whole
content occurs earlier is removed without sorting; of each content the earliest stays, and only where
one anchor has several contents do their suffixes have to be compared.

Those regions are dealt out by anchor, so suffixes that share ``SIZE`` bytes meet in one task, and
each task sorts its suffixes by the difference-cover algorithm modulo 3, with letters of 8 bytes:
triples of letters at the sampled two of three positions are sorted and named, names of names are
sorted again until they span the prefix, and the remaining third is merged in by its first letters
and the name of the sample after them. Adjacent suffixes with ``SIZE`` bytes in common form a class,
of which the earliest stays. Anchors with very many contents are compared by their windows' hashes
instead, in aggregates that combine before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm import anchors
from tablesmith.llm.common import hash128, row_key, text_of
from tablesmith.llm.decontam import bloom_filter, in_bloom
from tablesmith.session import scratch_tables, shuffles_deleted, stored

SIZE = 100
LETTER = 8
SHARD_BYTES = 200_000  # sorted at once, as anchors allow, to stay in the cache; positions must fit 21 bits
HOT_CONTENTS = 4_096  # an anchor with more contents is not put into one shard


def _named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense names of ``keys`` in sorted order, and that order."""
    order = np.argsort(keys)
    s = keys[order]
    names = np.zeros(len(keys), np.int64)
    names[order] = np.cumsum(np.concatenate(([False], s[1:] != s[:-1])))
    return names, order


def _triple(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return a << 42 | b << 21 | c


def _earliest(keys: np.ndarray, at: np.ndarray, rank: np.ndarray, later: np.ndarray) -> None:
    """Mark in ``later`` the positions ``at`` whose key a position of lesser ``rank`` has too."""
    if not len(at):
        return
    order = np.argsort(keys)
    s = keys[order]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    least = np.minimum.reduceat(rank[at[order]], first)
    later[at[order]] |= rank[at[order]] > np.repeat(least, np.diff(np.append(first, len(s))))


def repeated_windows(data: bytes, starts: np.ndarray, rank: np.ndarray | None = None) -> np.ndarray:
    """For each position whether a window of ``SIZE`` bytes begins there that also begins earlier.

    ``starts`` are the positions at which whole windows begin; nothing is said of others. What lies
    between texts takes no part: names are only compared as far as the window they belong to reaches.
    ``rank`` says of each position what is earlier, if it is not the positions themselves.
    """
    n = len(data)
    if n + SIZE >= 1 << 21:
        raise ValueError("names must fit 21 bits: sort fewer bytes at once")
    later = np.zeros(n, bool)
    if not len(starts):
        return later
    rank = np.arange(n) if rank is None else rank
    full = np.frombuffer(data + bytes(3 * SIZE), np.uint8)
    word = np.zeros(n + SIZE, np.uint64)
    for k in range(LETTER):
        word = word << np.uint64(8) | full[k : k + n + SIZE]
    letter, _ = _named(word)
    position = np.arange(n + SIZE - 3 * LETTER)
    kind = position // LETTER % 3
    sample = position[kind > 0]
    slot = np.full(n + 4 * SIZE, len(sample), np.int64)  # beyond the end: one name more than any
    slot[sample] = np.arange(len(sample))

    def at(names: np.ndarray, where: np.ndarray) -> np.ndarray:
        return np.append(names, 0)[slot[where]]

    # sort the sampled triples of letters, and compare neighbours to 4, 12, 20 and 24 bytes
    triples, order = _named(_triple(letter[sample], letter[sample + LETTER], letter[sample + 2 * LETTER]))
    in_order = sample[order]
    half = np.uint64(32)
    prefix = {}
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in range(3):
        w = word[in_order + k * LETTER]
        prefix[8 * k + 4] = same & ((w[1:] >> half) == (w[:-1] >> half))
        same = same & (w[1:] == w[:-1])
    for depth, equal in prefix.items():
        ids = np.zeros(len(sample), np.int64)
        ids[order] = np.cumsum(np.concatenate(([False], ~equal)))
        prefix[depth] = ids
    # recurse on the names: 72 bytes, and then the 100, 92 and 84 bytes that merging compares
    names, _ = _named(_triple(triples, at(triples, sample + 24), at(triples, sample + 48)))
    to_100 = _triple(names, at(triples, sample + 72), at(prefix[4], sample + 96))
    to_92, to_84 = names << 21 | at(prefix[20], sample + 72), names << 21 | at(prefix[12], sample + 72)
    names_92, _ = _named(to_92)
    names_84, _ = _named(to_84)
    # sampled suffixes among themselves, then the others merged with either kind of sample
    sampled = starts[starts // LETTER % 3 > 0]
    _earliest(to_100[slot[sampled]], sampled, rank, later)
    one = starts[starts // LETTER % 3 != 2]
    _earliest(letter[one] << 21 | names_92[slot[one + LETTER]], one, rank, later)
    two = starts[starts // LETTER % 3 != 1]
    _earliest(_triple(letter[two], letter[two + LETTER], names_84[slot[two + 2 * LETTER]]), two, rank, later)
    return later


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(flags, prepend=False, append=False))
    return edge[::2], edge[1::2]


def _scan(docs: DataFrame, schema: str, pick, bloom: np.ndarray | None = None) -> DataFrame:
    """Rows that ``pick(columns, found, texts, shared)`` makes of the regions of each group of texts."""
    shared = None if bloom is None else docs.sparkSession.sparkContext.broadcast(bloom)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0), batch.column(1).to_numpy()
            texts = [x.as_buffer().to_pybytes() for x in batch.column(2)]
            for first, data, ends in anchors.grouped(texts):
                found = anchors.regions(data, ends, SIZE)
                yield pick(ids, marks, first, found, data, ends, shared.value if shared else None)

    return docs.mapInArrow(work, schema)


def _anchor_counts(ids, marks, first, found, data, ends, bloom) -> pa.RecordBatch:
    values, counts = np.unique(found["anchor"].view(np.int64), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts.astype(np.int64))], names=["anchor", "n"])


def _place(ids, marks, first, found, hit) -> list:
    row = found["text"][hit] + first
    return [ids.take(pa.array(row)), pa.array(marks[row]), pa.array(found["start"][hit], pa.int64())]


def _occurrences(ids, marks, first, found, data, ends, bloom) -> pa.RecordBatch:
    hit = np.flatnonzero(in_bloom(bloom, found["anchor"]))
    own = [pa.array(found[c][hit].view(np.int64)) for c in ("anchor", "content")]
    return pa.RecordBatch.from_arrays(
        [*own, *_place(ids, marks, first, found, hit), pa.array(found["length"][hit], pa.int64())],
        names=["anchor", "content", "doc_id", "mark", "start", "length"],
    )


def _contents(ids, marks, first, found, data, ends, bloom) -> pa.RecordBatch:
    place = marks[found["text"] + first].view(np.uint64) ^ found["start"].astype(np.uint64)
    hit = np.flatnonzero(in_bloom(bloom, place))
    begin = (found["start"] + np.append(0, ends)[found["text"]])[hit].tolist()
    bytes_of = [data[a : a + n] for a, n in zip(begin, found["length"][hit].tolist())]
    own = pa.array(found["anchor"][hit].view(np.int64))
    return pa.RecordBatch.from_arrays(
        [own, *_place(ids, marks, first, found, hit), pa.array(found["place"][hit], pa.int64()), pa.array(bytes_of, pa.binary())],
        names=["anchor", "doc_id", "mark", "start", "place", "bytes"],
    )


def _sorted_shards(regions: DataFrame, kind: str) -> DataFrame:
    """Spans (``doc_id``, ``mark``, ``region`` (its start), ``start``, ``stop``) of repeated windows, by sorting suffixes shard by shard."""

    def spans(rows: list[tuple], id_kind: pa.DataType) -> pa.RecordBatch:
        sizes = np.array([len(r[5]) for r in rows])
        begin = np.cumsum(sizes) - sizes
        windows = sizes - SIZE + 1
        starts = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
        # regions of one anchor are ordered by id and the anchor's place; those that agree in both are equally early
        fresh = [0, *(x[0] != y[0] or x[1] != y[1] or x[4] != y[4] for x, y in zip(rows[1:], rows))]
        rank = np.repeat(np.cumsum(fresh), sizes)
        later = repeated_windows(b"".join(r[5] for r in rows), starts, rank)
        a, b = _runs(later)
        # a window's region ends 99 bytes beyond the last start, so runs never join two regions
        of = np.searchsorted(begin, a, side="right") - 1
        shift = np.array([r[3] for r in rows])[of] - begin[of]
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i][1] for i in of], id_kind), *(pa.array([rows[i][k] for i in of], pa.int64()) for k in (2, 3)), pa.array(a + shift), pa.array(b + shift + SIZE - 1)],
            names=["doc_id", "mark", "region", "start", "stop"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        of_anchor, known = [], set()

        def close() -> None:
            # a region that is alone with its anchor (a false hit of the filter) repeats nothing
            nonlocal size
            if len(of_anchor) > 1:
                rows.extend(of_anchor)
                size += sum(len(r[5]) for r in of_anchor)

        for batch in batches:
            id_kind = batch.schema.field("doc_id").type
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if of_anchor and row[0] != of_anchor[0][0]:
                    close()
                    of_anchor, known = [], set()
                    if size > SHARD_BYTES:
                        yield spans(rows, id_kind)
                        rows, size = [], 0
                # rows come by place: of equal regions the first is enough, what is later is removed whole and what is as early gets its spans
                if row[5] in known:
                    continue
                known.add(row[5])
                of_anchor.append(row)
        close()
        if rows:
            yield spans(rows, id_kind)

    dealt = regions.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "place", "mark")
    return dealt.select("anchor", "doc_id", "mark", "start", "place", "bytes").mapInArrow(work, f"doc_id {kind}, mark long, region long, start long, stop long")


def _hashed_windows(regions: DataFrame, keep) -> DataFrame:
    """The same spans, window by window: equal windows by 128-bit hash, at any number of them."""
    every = regions.select("doc_id", "mark", "start", "bytes", F.explode(F.expr(f"sequence(0, octet_length(bytes) - {SIZE})")).alias("i"))
    place = F.struct("doc_id", (F.col("start") + F.col("i")).alias("start"))
    windows = every.select(hash128(F.expr(f"substring(bytes, i + 1, {SIZE})")).alias("w"), place.alias("place"), "mark", F.col("start").alias("region"))
    first = keep(windows.groupBy("w").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "windows")
    later = windows.join(first, "w").where(F.col("place") > F.col("first"))
    return later.select("place.doc_id", "mark", "region", "place.start", (F.col("place.start") + SIZE).alias("stop"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_contents: int = HOT_CONTENTS) -> DataFrame:
    """``doc_id``, ``mark`` (tells rows of one id apart), ``start``, ``stop``: spans of bytes to remove, which may overlap.

    They are written to the shared folder; the far larger tables and shuffles they are found with are deleted as soon
    as the next step has what it needs of them.
    """
    with shuffles_deleted(docs.sparkSession), scratch_tables(docs.sparkSession) as keep:
        return stored(_spans(docs, keep, id_col, text_col, hot_contents), "spans")


def _spans(docs: DataFrame, keep, id_col: str, text_col: str, hot_contents: int) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col)["a"].alias("mark"), F.encode(text_of(text_col), "UTF-8").alias("bytes"))
    rows = rows.where(F.octet_length("bytes") >= SIZE)
    place = f"doc_id {kind}, mark long, start long"
    with scratch_tables(docs.sparkSession) as passing:
        copies, hot, bloom = _copies(rows, place, keep, passing, hot_contents)

    # anchors with several contents: the suffixes of the earliest regions
    texts = keep(_scan(rows, f"anchor long, {place}, place long, bytes binary", _contents, bloom), "suffixes")
    sorted_spans = _sorted_shards(texts.join(hot, "anchor", "left_anti"), kind)
    spans = sorted_spans.unionByName(_hashed_windows(texts.join(hot, "anchor", "left_semi"), keep))
    ties = copies.where(~F.col("later"))
    if not ties.isEmpty():
        # an id has several texts: a copy as early as the first loses what the first does
        spans = keep(spans, "shard-spans")
        ties = ties.select(F.col("mark").alias("also"), F.col("first_mark").alias("mark"), F.col("start").alias("region"))
        spans = spans.unionByName(spans.join(ties, ["mark", "region"]).drop("mark").withColumnRenamed("also", "mark"))
    return copies.where("later").select("doc_id", "mark", "start", "stop").unionByName(spans.drop("region"))


def _copies(rows: DataFrame, place: str, keep, passing, hot_contents: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Regions with an earlier or equally early copy, anchors of more than ``hot_contents`` contents, and a filter of the places whose suffixes are to be compared."""
    # anchors that occur twice; every other region is alone
    twice = _scan(rows, "anchor long, n long", _anchor_counts).groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    twice = passing(twice.select(F.col("anchor").alias("seed")), "anchors")
    found = _scan(rows, f"anchor long, content long, {place}, length long", _occurrences, bloom_filter(twice, twice.count()))
    found = passing(found, "regions")

    # of each content the earliest place stays, the others are removed whole
    at = F.struct("doc_id", "start", "mark")
    contents = passing(found.groupBy("anchor", "content").agg(F.min(at).alias("first"), F.max(at).alias("last")), "contents")
    met = found.join(contents.where("last > first").select("anchor", "content", "first"), ["anchor", "content"])
    later = F.struct("doc_id", "start") > F.struct("first.doc_id", "first.start")
    stop = (F.col("start") + F.col("length")).alias("stop")
    copies = met.select("doc_id", "mark", "start", stop, later.alias("later"), F.col("first.mark").alias("first_mark"))
    copies = keep(copies.where(F.col("later") | (F.col("mark") != F.col("first_mark"))), "copies")

    sizes = passing(contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "contested")
    contested = contents.join(sizes, "anchor").select(F.col("first.mark").bitwiseXOR(F.col("first.start")).alias("seed"))
    contested = passing(contested, "contested-places")
    hot = keep(sizes.where(F.col("n") > hot_contents).select("anchor"), "hot-anchors")
    return copies, hot, bloom_filter(contested, contested.count())


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True, hot_contents: int = HOT_CONTENTS) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (binary, unless off) and ``kept_sha256`` for each row.

    Removed is each byte that a string of ``SIZE`` bytes covers which also begins earlier: in a
    document of lesser id (null ids come first) or at a lesser place under the same id. Rows of one id
    are so judged by place alone: of strings that begin at one place in several of them none is earlier,
    and rows repeated in full get the same answer. Strings are judged on the input and never cross
    documents. A null or empty text has no bytes.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    spans = repeated_spans(docs, id_col, text_col, hot_contents)
    by_doc = spans.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    by_doc = by_doc.select(F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark"), F.transform("spans", lambda s: s["start"]).alias("starts"), F.transform("spans", lambda s: s["stop"]).alias("stops"))
    with shuffles_deleted(docs.sparkSession):
        marks = spans.select(F.col("mark").alias("seed")).distinct()
        touched = docs.sparkSession.sparkContext.broadcast(bloom_filter(marks, marks.count()))
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col)["a"].alias("mark"), F.encode(text_of(text_col), "UTF-8").alias("bytes"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Digests of the texts that lose nothing; of the others (and false hits of the filter) the bytes go on."""
        for batch in batches:
            hit = in_bloom(touched.value, batch.column(1).to_numpy().view(np.uint64))
            data = [x.as_buffer() for x in batch.column(2)]
            sha = [hashlib.sha256(x).hexdigest() for x in data]
            carried = batch.column(2) if with_kept else pc.if_else(pa.array(hit), batch.column(2), pa.scalar(None, batch.column(2).type))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([len(x) for x in data], pa.int64()), pa.array(sha, pa.string()), carried],
                names=["doc_id", "mark", "n_bytes", "kept_sha256", "bytes"],
            )

    rows = rows.mapInArrow(whole, f"doc_id {kind}, mark long, n_bytes long, kept_sha256 string, bytes binary")
    joined = rows.join(by_doc, (rows["mark"] == by_doc["of_mark"]) & rows["doc_id"].eqNullSafe(by_doc["of_id"]), "left")
    joined = joined.select("doc_id", "n_bytes", "kept_sha256", "bytes", "starts", "stops")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, sha, data, starts, stops in zip(*batch.columns[1:]):
                if starts.is_valid:
                    data = data.as_buffer().to_pybytes()
                    cover = np.zeros(len(data) + 1, np.int64)
                    np.add.at(cover, starts.values.to_numpy(), 1)
                    np.add.at(cover, stops.values.to_numpy(), -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    out.append((len(data), int(gone.sum()), len(_runs(gone)[0]), hashlib.sha256(kept).hexdigest(), kept))
                else:
                    out.append((n.as_py(), 0, 0, sha.as_py(), data.as_py()))
            if out:
                *counts, sha, kept = zip(*out)
                cols = [pa.array(c, pa.int64()) for c in counts]
                extra = [pa.array(kept, pa.binary())] if with_kept else []
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols, *extra, pa.array(sha, pa.string())], names=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", *(["kept"] if with_kept else []), "kept_sha256"]
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, {'kept binary, ' if with_kept else ''}kept_sha256 string"
    return joined.mapInArrow(work, schema)
