"""Per-column measures: all aggregates of a column in one pass, one result row per column."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.types import col

# Columns measured per pass. A pass reads only its own columns, so more passes cost no more
# input, and generated code stays within the JVM's method size.
COLUMNS_PER_PASS = 24


def per_column(df: DataFrame, measures: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """``(column, measure...)``; every column must have the same measure names and types."""
    names = list(measures)
    out = None
    for start in range(0, len(names), COLUMNS_PER_PASS):
        chunk = names[start : start + COLUMNS_PER_PASS]
        row = df.agg(
            *[F.struct(*[m.alias(k) for k, m in measures[c].items()]).alias(f"m{i}") for i, c in enumerate(chunk)]
        )
        keys = list(measures[chunk[0]])
        cells = [
            F.struct(F.lit(c).alias("column"), *[F.col(f"m{i}").getField(k).alias(k) for k in keys])
            for i, c in enumerate(chunk)
        ]
        part = row.select(F.inline(F.array(*cells)))
        out = part if out is None else out.unionAll(part)
    if out is None:
        raise ValueError("no columns to measure")
    return out


def copies_summary(df: DataFrame) -> DataFrame:
    """One row ``(rows, duplicate_rows, missing_cells)`` from one pass over the distinct rows."""
    nulls = sum((col(c).isNull().cast("bigint") for c in df.columns), F.lit(0).cast("bigint"))
    copies = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return copies.select("__n", nulls.alias("__nulls")).agg(
        total(F.col("__n")).alias("rows"),
        total(F.col("__n") - 1).alias("duplicate_rows"),
        total(F.col("__n") * F.col("__nulls")).alias("missing_cells"),
    )


def per_text(df: DataFrame, columns: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """``(column, measure...)`` where every measure is an aggregate over ``value``, the cell as text.

    The cells are unpivoted on the fly and combined per task, so a plan holds each measure once
    however many columns there are. Measures may test ``column``. Every named column gets a row,
    also in an empty table.
    """
    cell = [F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns]
    found = (
        df.select(F.inline(F.array(*cell))).groupBy("column").agg(*[m.alias(k) for k, m in measures.items()])
    )
    every = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"))
    return every.join(F.broadcast(found), "column", "left")


def column_in(columns: Iterable[str]) -> Column:
    """Whether ``column`` names one of these."""
    columns = sorted(columns)
    return F.col("column").isin(columns) if columns else F.lit(False)
