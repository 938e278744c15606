"""Row identity, white space and storage shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.session import stored

# The white space that separates words.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hash128(*cols: Column) -> Column:
    """Two independent 64-bit hashes as a struct, for keys that stand for long values."""
    return F.struct(F.xxhash64(F.lit(1), *cols).alias("a"), F.xxhash64(F.lit(2), *cols).alias("b"))


def row_key(id_col: str, text_col: str) -> Column:
    """Identity of a document. A null id differs from every other id, a null text is an empty one."""
    return hash128(F.col(id_col).isNull(), F.col(id_col), text_of(text_col))


def text_of(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several later passes read, once, to the shared folder."""
    return stored(df, name)


def least_row() -> Column:
    """An aggregate of ``key`` and ``doc_id``: the row of the least id, null ids last, and among equal ids of the least key."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("id"), F.col("key").alias("key")))


def one_of_each(docs: DataFrame, groups: DataFrame, group: str, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` for each group of ``groups`` (with ``key``, ``doc_id``): the one with the least id, null ids last.

    Among equal ids the least row key decides, and of rows repeated in full one stays.
    """
    best = groups.groupBy(group).agg(least_row().alias("best")).select(F.col("best.key").alias("key"))
    rows = docs.select(F.struct("*").alias("row"), row_key(id_col, text_col).alias("key"))
    return rows.join(best, "key").groupBy("key").agg(F.first("row").alias("row")).select("row.*")
