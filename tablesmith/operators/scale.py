"""Outlier bounds, outlier removal and normalisation.

Bounds are fitted by one aggregate and applied as literals, so the filter that follows is
an ordinary predicate the Parquet scan can use.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.operators.quantiles import exact_quantiles
from tablesmith.session import first_row
from tablesmith.types import INTEGER, col, column_types, numeric_columns

IQR_FACTOR = 1.5
Z_LIMIT = 3.0
# Scale of the modified z-score and its limit.
MODIFIED_Z_SCALE = 0.6745
MODIFIED_Z_LIMIT = 3.5


def iqr_bounds(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float, float]]:
    """``(low, high, iqr)`` per column that has values."""
    out = {}
    for c, (q1, q3) in exact_quantiles(df, columns, [0.25, 0.75]).items():
        if q1 is not None:
            iqr = q3 - q1
            out[c] = (q1 - IQR_FACTOR * iqr, q3 + IQR_FACTOR * iqr, iqr)
    return out


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    """``(mean, population standard deviation)`` per column."""
    if not columns:
        return {}
    aggs = [F.struct(F.avg(col(c)), F.stddev_pop(col(c))).alias(c) for c in columns]
    row = df.agg(*aggs).first()
    return {c: (row[c][0], row[c][1]) for c in columns}


def outside(c: str, low: float, high: float) -> Column:
    return (col(c) < F.lit(low)) | (col(c) > F.lit(high))


def z_score(c: str, mean: float, std: float) -> Column:
    return (col(c) - F.lit(mean)) / F.lit(std)


def _within(df: DataFrame, c: str, low: float, high: float) -> Column:
    """Plain bounds, whole ones for whole numbers, so that the scan can use them."""
    if column_types(df)[c] == INTEGER and math.isfinite(low) and math.isfinite(high):
        low, high = math.ceil(low), math.floor(high)
    return (col(c) >= F.lit(low)) & (col(c) <= F.lit(high))


def remove_outliers(
    df: DataFrame, method: str = "iqr", columns: Sequence[str] | None = None, threshold: float = Z_LIMIT
) -> DataFrame:
    """Keep rows that are inside the bounds in every numeric column; nulls pass."""
    chosen = numeric_columns(df, columns)
    keep: list[Column] = []
    if method == "iqr":
        for c, (low, high, _) in iqr_bounds(df, chosen).items():
            keep.append(col(c).isNull() | _within(df, c, low, high))
    elif method == "zscore":
        for c, (mean, std) in moments(df, chosen).items():
            if std:
                keep.append(col(c).isNull() | _within(df, c, mean - threshold * std, mean + threshold * std))
    return df.where(functools.reduce(operator.and_, keep)) if keep else df


def normalize(df: DataFrame, method: str = "minmax", columns: Sequence[str] | None = None) -> DataFrame:
    """Scale numeric columns to 0..1 or to zero mean and unit (population) deviation.

    A constant column becomes 0, and so do its nulls.
    """
    chosen = numeric_columns(df, columns)
    if not chosen:
        return df
    scaled = {}
    if method == "minmax":
        aggs = [F.struct(F.min(col(c)).cast("double"), F.max(col(c)).cast("double")).alias(c) for c in chosen]
        row = first_row(df.agg(*aggs))
        for c in chosen:
            low, high = row[c]
            flat = low is None or high == low
            scaled[c] = F.lit(0.0) if flat else (col(c).cast("double") - F.lit(low)) / F.lit(high - low)
    elif method == "standard":
        for c, (mean, std) in moments(df, chosen).items():
            scaled[c] = z_score(c, mean, std) if std else F.lit(0.0)
    return df.withColumns(scaled) if scaled else df
