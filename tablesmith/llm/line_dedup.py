"""Drop lines that many documents share.

Lines are normalised, hashed to 128 bits and counted by distinct documents. The lines over the
threshold travel back as positions, and each document is put together again from the slices of
lines between them, in time linear in its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.binding import let
from tablesmith.llm.common import BLANKS, hash128, keep, lower_ascii, row_key, text_of


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The dropped lines: ``key`` (of the document), ``pos`` and ``line_key`` (its hash)."""
    lines = (
        docs.select(row_key(id_col, text_col).alias("key"), F.posexplode(F.split(text_of(text_col), "\n", -1)).alias("pos", "line"))
        .select("key", "pos", line_key(F.col("line")).alias("line"))
        .where(F.length("line") >= min_chars)
        .select("key", "pos", hash128(F.col("line")).alias("line_key"))
    )
    # the first distinct is map-side combined; one very common line is one row per document
    spread = lines.select("key", "line_key").distinct().groupBy("line_key").count().where(F.col("count") >= min_docs)
    # written, so that the join has plain exchanges below it and Spark can split a very common line
    return lines.join(keep(spread.select("line_key"), "common-lines"), "line_key", "left_semi")


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the shared lines taken out of the text, plus ``n_lines`` and ``n_dropped``.

    A line whose key has at least ``min_chars`` code points and occurs in at least ``min_docs``
    documents goes everywhere; repeats inside a document count once. A null or empty text is one
    empty line and comes back as the empty text. Rows repeated in full count as one document. An
    input column called ``n_lines`` or ``n_dropped`` is replaced. An empty table gives an empty one.
    """
    dropped = (
        common_lines(docs, min_docs, min_chars, id_col, text_col)
        .groupBy("key")
        .agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    )
    rows = docs.select(F.struct("*").alias("row"), row_key(id_col, text_col).alias("key"))
    joined = rows.join(dropped, "key", "left")
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    others = [F.col("row")[c].alias(c) for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    return joined.select(
        *others,
        F.when(F.col("dropped").isNull(), text).otherwise(_without(text, F.col("dropped"))).alias(text_col),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def _without(text: Column, dropped: Column) -> Column:
    """The lines outside the sorted positions ``dropped``, joined again."""

    def pieces(lines: Column) -> Column:
        ends = F.concat(F.array(F.lit(-1)), dropped, F.array(F.size(lines)))
        return let(
            ends,
            lambda at: F.flatten(
                F.transform(
                    F.sequence(F.lit(0), F.size(at) - 2),
                    lambda i: F.slice(lines, F.get(at, i) + 2, F.get(at, i + 1) - F.get(at, i) - 1),
                )
            ),
        )

    return F.array_join(let(F.split(text, "\n", -1), pieces), "\n")
