"""Records that span lines, read in splits: quoted CSV, JSON arrays, XML rows.

Spark's text source cuts a file at a separator and deals its splits to many tasks. Whether a piece
begins inside a record depends on all before it, so each split first says in which state (and depth)
it would end for every state it might begin in. These small functions are composed along each file,
one row for each split, and tell every split where it begins. Then each split puts together the records
that begin in it; what is left open at its end is joined with the beginnings of the splits that follow.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablesmith.session import scratch_path


@dataclass(frozen=True)
class Format:
    """How records lie in pieces of text.

    ``walk(piece, state)`` gives the state after a piece and its separator and the change of depth;
    between records the depth is ``base``. ``begin(piece, state)`` is the part of a piece that starts a
    record, or None.
    """

    separator: str
    states: int
    base: int
    walk: Callable[[str, int], tuple[int, int]]
    begin: Callable[[str, int], str | None]
    end: str = ""  # what of the separator belongs to a record
    within: tuple[int, ...] = ()  # states that only a record can be in


def _split_id(names: list[str]) -> list:
    return [F.col("_metadata.file_path").alias(names[0]), F.col("_metadata.file_block_start").alias(names[1])]


def _pieces(spark: SparkSession, path: str, kind: Format) -> DataFrame:
    return spark.read.option("lineSep", kind.separator).text(path).select("value", *_split_id(["file", "block"]))


def _starts(pieces: DataFrame, kind: Format) -> DataFrame:
    """``file``, ``block``, ``state``, ``depth``: where each split begins. One row for each split."""

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            cols = [pa.array([now[0]]), pa.array([now[1]], pa.int64()), pa.array([[e[0] for e in ends]], pa.list_(pa.int32())), pa.array([[e[1] for e in ends]], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, names=["file", "block", "ends", "deltas"])

        now, ends = None, []
        for batch in batches:
            for value, *split in zip(*(c.to_pylist() for c in batch.columns)):
                if split != now:
                    if now is not None:
                        yield row()
                    now, ends = split, [(s, 0) for s in range(kind.states)]
                known: dict[int, tuple[int, int]] = {}
                for i, (state, depth) in enumerate(ends):
                    if state not in known:
                        known[state] = kind.walk(value, state)
                    ends[i] = (known[state][0], depth + known[state][1])
        if now is not None:
            yield row()

    def along(splits: pd.DataFrame) -> pd.DataFrame:
        splits = splits.sort_values("block")
        state, depth, out = 0, 0, []
        for ends, deltas in zip(splits["ends"], splits["deltas"]):
            out.append((state, depth))
            state, depth = int(ends[state]), depth + int(deltas[state])
        return splits[["file", "block"]].assign(state=[s for s, _ in out], depth=[d for _, d in out])

    functions = pieces.select("value", "file", "block").mapInArrow(effects, "file string, block long, ends array<int>, deltas array<long>")
    return functions.groupBy("file").applyInPandas(along, "file string, block long, state int, depth long")


def records(spark: SparkSession, path: str, kind: Format) -> DataFrame:
    """``text`` of each record, and whether it is the ``first`` of its file. Every record is there once."""
    pieces = _pieces(spark, path, kind)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_, own, first = None, False, False, False
        held: list[str] = []
        out: list[tuple] = []

        def row(role: str) -> None:
            # below the base: only empty elements, and no closing tag after them
            text = kind.separator.join(held) + (kind.end if role in ("whole", "closed") and depth == kind.base else "")
            out.append((now[0], now[1], role, first and own, text))
            held.clear()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["file", "block", "role", "first", "text"])
            out.clear()
            return batch

        types = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
        for batch in batches:
            for value, *split, at, level in zip(*(c.to_pylist() for c in batch.columns)):
                if split != now:
                    if held:
                        row("open" if own else "middle")
                    now, state, depth, first = split, at, level, split[1] == 0
                    own, open_ = False, level > kind.base or at in kind.within
                if open_:
                    held.append(value)
                else:
                    text = kind.begin(value, state)
                    open_ = own = text is not None
                    if own:
                        held.append(text)
                state, delta = kind.walk(value, state)
                depth += delta
                if open_ and state == 0 and depth <= kind.base:
                    row("whole" if own else "closed")
                    first = first and not own
                    own = open_ = False
            if out:
                yield flush()
        if held:
            row("open" if own else "middle")
        if out:
            yield flush()

    # one row for each split of the files: as many as there are tasks
    starts = F.broadcast(_starts(pieces, kind))
    placed = pieces.join(starts, ["file", "block"]).select("value", "file", "block", "state", "depth")
    every = placed.mapInArrow(parts, "file string, block long, role string, first boolean, text string")
    whole = every.where("role = 'whole'").select("text", "first")
    # what crosses the end of a split: at most two rows for each
    crossing = every.where("role <> 'whole'")
    order = F.struct("block", (F.col("role") == "open").alias("late"))
    begun = F.count_if(F.col("role") == "open").over(Window.partitionBy("file").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = crossing.withColumns({"place": order, "record": begun}).groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("place", "text"))).alias("of"), F.bool_or("first").alias("first"), F.bool_or(F.col("role") == "closed").alias("closed")
    )
    # an open record at the end of a file is one in delimited text, and none in the others
    complete = joined.where((F.col("record") > 0) & (F.col("closed") | F.lit(not kind.end)))
    return whole.unionAll(complete.select(F.array_join(F.col("of.text"), kind.separator).alias("text"), "first"))


_CLOSING = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')


def delimited(sep: str) -> Format:
    """Lines of fields that may stand in quotes, where quotes are doubled and line breaks allowed."""
    opening = sep + '"'

    def walk(line: str, state: int) -> tuple[int, int]:
        if '"' not in line:
            return state, 0
        at = 0
        if not state and not line.removeprefix("\ufeff").startswith('"'):
            at = line.find(opening)
            if at < 0:
                return 0, 0
            at += len(sep)
        if not state:
            at = line.index('"', at) + 1
        while True:
            closed = _CLOSING.match(line, at)
            if not closed:
                return 1, 0
            at = line.find(opening, closed.end())
            if at < 0:
                return 0, 0
            at += len(opening)

    return Format("\n", 2, 0, walk, lambda line, _: line if line.strip() else None, within=(1,))


_JSON_MARKS = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*("?)|[{}\[\]]', re.S)
_JSON_STRING_END = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)


def json_array() -> Format:
    """The objects of one array, cut after closing braces; state 1 is inside a string."""

    def walk(piece: str, state: int) -> tuple[int, int]:
        at, depth = 0, 0
        if state:
            ended = _JSON_STRING_END.match(piece)
            if not ended:
                return 1, 0
            at = ended.end()
        for mark in _JSON_MARKS.finditer(piece, at):
            c = mark.group()[0]
            if c == '"':
                if not mark.group(1):
                    return 1, depth
            else:
                depth += 1 if c in "{[" else -1
        return 0, depth - 1

    def begin(piece: str, state: int) -> str | None:
        return piece.lstrip(" \t\r\n,[]\ufeff") or None

    return Format("}", 2, 1, walk, begin, "}")


def xml_rows(row_tag: str) -> Format:
    """Elements of one name, cut after their closing tags (which hold no blanks); states 1 and 2 are inside
    a comment and inside CDATA. Empty elements ahead of another one come with it."""
    marks = re.compile(rf"<!--|<!\[CDATA\[|<{re.escape(row_tag)}(?=[\s/>])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*?(/?)>", re.S)
    ends = {1: "-->", 2: "]]>"}

    def tags(piece: str, state: int) -> Iterator[tuple[int, int, int, str]]:
        """Start, end, state after it and kind (``<`` opens, ``/`` is empty) of each mark that counts."""
        at = 0
        while True:
            if state:
                at = piece.find(ends[state], at)
                if at < 0:
                    return
                at += 3
                state = 0
                yield at, at, 0, ""
            mark = marks.search(piece, at)
            if not mark:
                return
            at = mark.end()
            if mark.group().startswith("<!"):
                state = 1 if mark.group() == "<!--" else 2
                yield at, at, state, ""
            else:
                yield mark.start(), at, 0, "/" if mark.group(1) else "<"

    def walk(piece: str, state: int) -> tuple[int, int]:
        depth = 0
        for _, _, state, text in tags(piece, state):
            depth += text == "<"
        # a closing tag inside a comment or CDATA is text
        return (state, depth) if state else (0, depth - 1)

    def begin(piece: str, state: int) -> str | None:
        found = [m for m in tags(piece, state) if m[3]]
        if not found:
            return None
        opened = any(m[3] == "<" for m in found)
        return piece[found[0][0] : len(piece) if opened else found[-1][1]]

    return Format(f"</{row_tag}>", 3, 0, walk, begin, f"</{row_tag}>")


def as_lines(spark: SparkSession, path: str, kind: Format, name: str) -> str:
    """Write the records of ``path`` one a line to the shared folder; the folder written."""
    to = scratch_path(spark, name)
    records(spark, path, kind).select(F.regexp_replace("text", r"[\r\n]+", " ")).write.text(to)
    return to


def as_documents(spark: SparkSession, path: str, kind: Format, root_tag: str, name: str) -> str:
    """Write the records of ``path`` to the shared folder, in files that are documents of their own; the folder written."""

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = lambda text: pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])
        some = False
        for batch in batches:
            if batch.num_rows:
                if not some:
                    yield line(f"<{root_tag}>")
                some = True
                yield batch
        if some:
            yield line(f"</{root_tag}>")

    to = scratch_path(spark, name)
    records(spark, path, kind).select("text").mapInArrow(rooted, "text string").write.text(to)
    return to
