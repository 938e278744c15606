"""The value table: how often each distinct value occurs in each column.

Distinct counts, modes, top values and entropy all read it, so a profile pays one shuffle of
map-side combined (column, value) pairs instead of one distinct expansion per statistic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.types import FLOAT, INTEGER, col, column_types


def value_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, number, n)`` over the non-null values; ``number`` orders numeric ties.

    Bigint and double cells are grouped as they are and written as text afterwards, once per
    distinct value.
    """
    kinds = column_types(df)

    def cell(c: str):
        dtype = df.schema[c].dataType
        whole = col(c).cast("bigint") if kinds[c] == INTEGER else F.lit(None).cast("bigint")
        real = col(c) if isinstance(dtype, T.DoubleType) else F.lit(None).cast("double")
        own = kinds[c] == INTEGER or isinstance(dtype, T.DoubleType)
        text = F.lit(None).cast("string") if own else col(c).cast("string")
        order = col(c).cast("double") if kinds[c] == FLOAT and not own else F.lit(None).cast("double")
        named = {"column": F.lit(c), "whole": whole, "real": real, "text": text, "order": order}
        return F.struct(*[v.alias(k) for k, v in named.items()])

    cells = df.select(F.inline(F.array(*[cell(c) for c in columns])))
    keys = ["column", "whole", "real", "text", "order"]
    counted = cells.where("whole IS NOT NULL OR real IS NOT NULL OR text IS NOT NULL").groupBy(*keys)
    return counted.agg(F.count(F.lit(1)).alias("n")).select(
        "column",
        F.coalesce(F.col("whole").cast("string"), F.col("real").cast("string"), "text").alias("value"),
        F.coalesce(F.col("whole").cast("double"), "real", "order").alias("number"),
        "n",
    )


def value_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, non_null, unique, top, top_count, entropy)``; the smallest value wins a tie."""
    # -sum(p * log2 p) rewritten so that it needs no total up front
    weighted = F.sum(F.col("n") * F.log2(F.col("n").cast("double")))
    total = F.sum("n")
    first = F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), "number", "value"))
    return (
        value_table(df, columns)
        .groupBy("column")
        .agg(
            total.alias("non_null"),
            F.count(F.lit(1)).alias("unique"),
            first.alias("first"),
            (F.log2(total.cast("double")) - weighted / total).alias("entropy"),
        )
        .select("column", "non_null", "unique", F.col("first.value").alias("top"), F.col("first.n").alias("top_count"), "entropy")
    )


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value per column as text (one row per column reaches the driver)."""
    if not columns:
        return {}
    found = {r["column"]: r["top"] for r in value_summary(df, columns).select("column", "top").collect()}
    return {c: found.get(c) for c in columns}


def mode_literal(df: DataFrame, column: str, value: str | None):
    """A mode found by :func:`modes`, as a literal of the column's own type."""
    return F.lit(value).cast(df.schema[column].dataType)


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row ``(rows, duplicate_rows)``; rows beyond the first of each copy count as duplicates."""
    keys = list(columns or df.columns)
    copies = df.groupBy(*[col(c) for c in keys]).agg(F.count(F.lit(1)).alias("__copies"))
    return copies.agg(
        F.coalesce(F.sum("__copies"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).alias("duplicate_rows"),
    )


