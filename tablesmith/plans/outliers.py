"""Outliers by three methods: a report of counts, and the flagged cells."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.numbers import count_where
from tablesmith.operators import scale
from tablesmith.operators.quantiles import exact_quantiles, median_absolute_deviation
from tablesmith.operators.stats import per_column
from tablesmith.types import col, numeric_columns

REPORT_SCHEMA = (
    "column string, iqr_count bigint, iqr_low double, iqr_high double, zscore_count bigint, "
    "modified_zscore_count bigint, total_unique bigint"
)


@dataclass(frozen=True)
class Fit:
    """What the three methods need to know about a column."""

    low: float
    high: float
    iqr: float
    median: float
    mean: float
    std: float
    mad: float | None

    def iqr_outlier(self, c: str) -> Column:
        return scale.outside(c, self.low, self.high) if self.iqr > 0 else F.lit(False)

    def z_outlier(self, c: str) -> Column:
        return F.abs(scale.z_score(c, self.mean, self.std)) > scale.Z_LIMIT if self.std else F.lit(False)

    def modified_z_outlier(self, c: str) -> Column:
        if not self.mad:
            return F.lit(False)
        distance = F.lit(scale.MODIFIED_Z_SCALE) * (col(c) - F.lit(self.median)) / F.lit(self.mad)
        return F.abs(distance) > scale.MODIFIED_Z_LIMIT


def fit(df: DataFrame, columns: Sequence[str]) -> dict[str, Fit]:
    """Quartiles, moments and MAD of each column that holds values."""
    quartiles = {c: v for c, v in exact_quantiles(df, columns, [0.25, 0.5, 0.75]).items() if v[0] is not None}
    moments = scale.moments(df, list(quartiles))
    mads = median_absolute_deviation(df, {c: v[1] for c, v in quartiles.items()})
    out = {}
    for c, (q1, median, q3) in quartiles.items():
        iqr = q3 - q1
        low, high = q1 - scale.IQR_FACTOR * iqr, q3 + scale.IQR_FACTOR * iqr
        out[c] = Fit(low, high, iqr, median, *moments[c], mads[c])
    return out


def outlier_report(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    """Per numeric column: outlier counts by IQR, z-score and modified z-score, the IQR bounds,
    and the rows any method flags. Nothing is removed."""
    fits = fit(df, numeric_columns(df, columns))
    if not fits:
        return df.sparkSession.createDataFrame([], REPORT_SCHEMA)
    measures = {}
    for c, f in fits.items():
        by_iqr, by_z, by_mz = f.iqr_outlier(c), f.z_outlier(c), f.modified_z_outlier(c)
        bounded = f.iqr > 0
        measures[c] = {
            "iqr_count": count_where(by_iqr),
            "iqr_low": F.max(F.lit(round(f.low, digits) if bounded else None).cast("double")),
            "iqr_high": F.max(F.lit(round(f.high, digits) if bounded else None).cast("double")),
            "zscore_count": count_where(by_z),
            "modified_zscore_count": count_where(by_mz),
            "total_unique": count_where(by_iqr | by_z | by_mz),
        }
    return per_column(df, measures)
