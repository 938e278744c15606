"""Filling missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.operators.ordering import SLICE_ROWS, fill_along
from tablesmith.operators.quantiles import exact_quantiles
from tablesmith.operators.values import mode_literal, modes
from tablesmith.session import first_row
from tablesmith.types import col, numeric_columns, select_columns

METHODS = ("mean", "median", "mode", "ffill", "bfill", "constant")


def means(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return first_row(df.agg(*[F.avg(col(c)).alias(c) for c in columns])) if columns else {}


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return {c: v[0] for c, v in exact_quantiles(df, columns, [0.5]).items()}


def with_gaps(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those columns that miss a value; the others keep their type and every digit."""
    gaps = first_row(df.agg(*[F.count_if(col(c).isNull()).alias(c) for c in columns])) if columns else {}
    return [c for c in columns if gaps[c]]


def _fill_with(df: DataFrame, values: dict) -> DataFrame:
    known = {c: v for c, v in values.items() if v is not None}
    return df.withColumns({c: F.coalesce(col(c), F.lit(v)) for c, v in known.items()}) if known else df


def fill_missing(
    df: DataFrame,
    method: str = "mean",
    columns: Sequence[str] | None = None,
    value=0,
    row_id: str | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Fill nulls by mean, median, mode, ffill, bfill or a constant.

    Mean and median act on numeric columns with gaps only; these become doubles. ``ffill`` and ``bfill`` look along ``row_id``.
    """
    if method == "mean":
        return _fill_with(df, means(df, with_gaps(df, numeric_columns(df, columns))))
    if method == "median":
        return _fill_with(df, medians(df, with_gaps(df, numeric_columns(df, columns))))
    if method == "mode":
        found = {c: v for c, v in modes(df, select_columns(df, columns)).items() if v is not None}
        return df.withColumns({c: F.coalesce(col(c), mode_literal(df, c, v)) for c, v in found.items()})
    if method in ("ffill", "bfill"):
        if row_id is None:
            raise ValueError(f"{method} needs row_id, the column that orders the rows")
        return fill_along(df, columns, row_id, backward=method == "bfill", slice_rows=slice_rows)
    if method == "constant":
        kinds = dict(df.dtypes)
        text = isinstance(value, str)
        fits = [
            c
            for c in select_columns(df, columns)
            if (kinds[c] == "string") or (not text and c in numeric_columns(df)) or kinds[c] == "boolean"
        ]
        return df.withColumns({c: F.coalesce(col(c), F.lit(value).cast(kinds[c])) for c in fits})
    raise ValueError(f"unknown fill method '{method}'; one of {', '.join(METHODS)}")
