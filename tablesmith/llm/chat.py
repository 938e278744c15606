"""Render chat turns with control marks, and prove by reparsing that nothing was lost.

A turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. Text that holds a control string would be
read as marks, so after each rendering a deterministic parser reads the turn back; while it differs
from the source, the contents are escaped one level further. Escaping puts one backslash between
``<`` and ``|`` (more where some stand there already) and is undone by taking one away.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_OPEN, _MARK = re.compile(r"<(\\*)\|"), re.compile(r"<\|im_(start|end)\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|")

TURNS = "conv_id long, turn long, role string, text string, rendered string, escapes int, loss_from long, loss_chars long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str, is_role: bool = False) -> str:
    """Reversible: no control string is left, and in a role no line end either."""
    if is_role:
        text = text.replace("\\", "\\\\").replace("\n", "\\n")
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str, is_role: bool = False) -> str:
    text = _ESCAPED.sub(r"<\1|", text)
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", text) if is_role else text


def parse(rendered: str) -> list[tuple[str, str]] | None:
    """The turns of a rendered text, or None where it doesn't follow the grammar
    ``(START role LF text END LF)*`` with no mark inside role or text."""
    turns, at, marks = [], 0, list(_MARK.finditer(rendered))
    if len(marks) % 2:
        return None
    for first, last in zip(marks[::2], marks[1::2]):
        if first[0] != START or last[0] != END or first.start() != at or rendered[last.end() : last.end() + 1] != "\n":
            return None
        role, line_end, text = rendered[first.end() : last.start()].partition("\n")
        if not line_end:
            return None
        turns.append((unescape(role, True), unescape(text)))
        at = last.end() + 1
    return turns if at == len(rendered) else None


def render(role: str, text: str) -> tuple[str, int, str]:
    """The rendered turn, how often its contents were escaped, and the text as it stands in it.

    Reading back undoes one level, so the first level is enough; the loop is the check.
    """
    for level in range(3):
        shown_role, shown = (role, text) if not level else (escape(role, True), escape(text))
        rendered = f"{START}{shown_role}\n{shown}{END}\n"
        if parse(rendered) == [(role, text)]:
            return rendered, level, shown
    raise AssertionError("a turn can't be read back")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _ordered(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )


def format_turns(conversations: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn with its rendered form; a conversation's text is its turns' in order.

    ``escapes`` counts the levels needed, ``loss_from`` and ``loss_chars`` span the code points of
    ``rendered`` the loss falls on (none outside ``loss_roles``). Null roles and texts are empty,
    null ids are a conversation of their own. Rows are rendered where they are, without a shuffle,
    so the length of a conversation does not matter here.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, turn, role, text in _rows([batch]):
                rendered, escapes, shown = render(role, text)
                lossy = role in loss_roles
                out.append((conv, turn, role, text, rendered, escapes, len(rendered) - len(END) - 1 - len(shown) if lossy else 0, len(shown) if lossy else 0))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TURN_TYPES)], names=_TURN_NAMES)

    return _ordered(conversations).mapInArrow(work, TURNS)


_TURN_NAMES = [x.split()[0] for x in TURNS.split(", ")]
_TURN_TYPES = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]] for x in TURNS.split(", ")]


def digest_turns(turns: DataFrame) -> DataFrame:
    """One row per conversation, read back from ``rendered``: counts and hashes of turns and loss.

    Turns are ordered by turn, then role and text; equal rows stay separate turns. A conversation
    streams through its task turn by turn: only hash states are held, whatever its length.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, state = [], None
        for conv, rendered, loss_from, loss_chars in _rows(batches):
            if state is None or state[0] != conv:
                if state is not None:
                    done.append(_closed(state))
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if len(done) >= 1000:
                    yield _batch(done)
                    done = []
            ((role, text),) = parse(rendered)
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode())
            if loss_chars:
                masked = unescape(rendered[loss_from : loss_from + loss_chars])
                state[3] += len(masked)
                state[4].update(masked.encode())
            state[5] += len(rendered)
        if state is not None:
            done.append(_closed(state))
        if done:
            yield _batch(done)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "rendered", "loss_from", "loss_chars").mapInArrow(work, DIGESTS)


def _closed(state: list) -> tuple:
    conv, n, turns, loss_chars, loss, chars = state
    return conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in DIGESTS.split(", ")])
