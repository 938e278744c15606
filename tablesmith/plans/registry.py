"""The named cleaning operations and pipelines of them."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame

from tablesmith.operators import columns, fill, rows, scale
from tablesmith.types import numeric_columns, text_columns

OPERATIONS: dict[str, Callable[..., DataFrame]] = {
    "remove_duplicates": rows.remove_duplicates,
    "drop_nulls": rows.drop_nulls,
    "fill_missing": fill.fill_missing,
    "remove_special_chars": columns.remove_special_chars,
    "trim_spaces": columns.trim_spaces,
    "change_case": columns.change_case,
    "remove_outliers": scale.remove_outliers,
    "normalize": scale.normalize,
    "label_encode": columns.label_encode,
    "one_hot_encode": columns.one_hot_encode,
    "change_dtype": columns.change_dtype,
    "rename_column": columns.rename_column,
    "split_column": columns.split_column,
    "merge_columns": columns.merge_columns,
    "drop_columns": columns.drop_columns,
    "filter_rows": rows.filter_rows,
    "sample_rows": rows.sample_rows,
    "formula_column": columns.formula_column,
}


def list_operations() -> list[str]:
    return list(OPERATIONS)


def apply_operation(df: DataFrame, name: str, params: Mapping | None = None) -> DataFrame:
    if name not in OPERATIONS:
        raise ValueError(f"unknown operation '{name}'")
    return df.transform(OPERATIONS[name], **(params or {}))


def apply_operations(df: DataFrame, steps: Sequence[tuple[str, Mapping]]) -> DataFrame:
    """A pipeline of (operation, parameters); Catalyst sees all of it as one plan."""
    return functools.reduce(lambda d, step: apply_operation(d, *step), steps, df)


AUTO_CLEAN_STEPS = ("remove_duplicates", "trim_spaces", "fill median", "fill mode")


def auto_clean(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Drop duplicate rows, trim texts, fill numbers with the median and texts with the mode."""
    out = columns.trim_spaces(rows.remove_duplicates(df, row_id=row_id))
    numeric = [c for c in numeric_columns(out) if c != row_id]
    if numeric:
        out = fill.fill_missing(out, "median", numeric)
    texts = text_columns(out)
    return fill.fill_missing(out, "mode", texts) if texts else out
