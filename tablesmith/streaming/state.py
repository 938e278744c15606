"""Operations on a streaming table that need state, bounded by a watermark.

A watermark of ``delay`` says how late a row may come: state for times further back than that is let
go, so it holds what the delay spans and not the history of the stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.types import col, numeric_columns, q, require_columns, select_columns


def _timed(stream: DataFrame, time_column: str, delay: str) -> DataFrame:
    require_columns(stream, [time_column])
    if not isinstance(stream.schema[time_column].dataType, (T.TimestampType, T.TimestampNTZType)):
        raise ValueError(f"'{time_column}' must be a timestamp")
    return stream.withColumn("__time", col(time_column)).withWatermark("__time", delay)


def remove_duplicates_stream(stream: DataFrame, time_column: str, delay: str, subset: Sequence[str] | None = None) -> DataFrame:
    """The first row that arrives of those that agree on ``subset`` (all columns without it).

    As ``rows.remove_duplicates`` as long as copies come within ``delay`` of each other. Null values
    agree with each other. Rows later than the watermark are left out; rows without a time are judged
    like others but never expire.
    """
    require_columns(stream, subset or [])
    names = select_columns(stream, subset)
    out = _timed(stream, time_column, delay).dropDuplicatesWithinWatermark([*names])
    return out.drop("__time")


def daily_totals_stream(stream: DataFrame, time_column: str, delay: str, target: str | None = None) -> DataFrame:
    """``date``, ``value``: for each day the sum of a numeric target, else the row count.

    In append mode a day comes out once, when the watermark has passed its end: it is final then, and equals
    what ``forecast.daily_series`` has for that day if no row was later than ``delay``. Days without
    rows don't come out; rows without a time count nowhere.
    """
    summed = target is not None and target in numeric_columns(stream)
    value = F.sum(q(target)) if summed else F.count(F.lit(1))
    days = _timed(stream, time_column, delay).groupBy(F.window("__time", "1 day").alias("day"))
    totals = days.agg(F.coalesce(value, F.lit(0)).cast("double").alias("value"))
    return totals.select(F.col("day.start").cast("date").alias("date"), "value")
