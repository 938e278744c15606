"""Daily series and three forecasts.

The first aggregate turns any number of rows into one row per day; everything after it is as
small as the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablesmith.functions import dates
from tablesmith.types import DATETIME, STRING, col, column_types, numeric_columns, require_columns

METHODS = ("linear", "moving_average", "seasonal_naive")
_WEEK = 7


def infer_date_column(df: DataFrame) -> str | None:
    """The first column that is a date or is named like one."""
    for name, kind in column_types(df).items():
        if kind == DATETIME or "date" in name.lower() or "time" in name.lower():
            return name
    return None


def daily_series(df: DataFrame, date_column: str, target: str | None = None) -> DataFrame:
    """``(date, value)``: per day the sum of a numeric target, else the row count; gaps are 0."""
    require_columns(df, [date_column])
    kind = column_types(df)[date_column]
    day = dates.parse_date(col(date_column)) if kind == STRING else col(date_column).try_cast("date")
    summed = target is not None and target in numeric_columns(df)
    value = F.sum(col(target)) if summed else F.count(F.lit(1))
    known = df.select(day.alias("date"), *([col(target)] if summed else [])).where("date IS NOT NULL")
    daily = known.groupBy("date").agg(F.coalesce(value, F.lit(0)).cast("double").alias("value"))
    # one row of bounds, exploded: nothing when there was no date
    calendar = daily.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(
        F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("date")
    )
    return calendar.join(daily, "date", "left").select("date", F.coalesce("value", F.lit(0.0)).alias("value"))


def _future(horizon: int):
    """The steps 1..horizon after the last day, as an array."""
    return F.sequence(F.lit(1), F.lit(horizon))


def _check(horizon: int) -> None:
    if not 1 <= horizon <= 365:
        raise ValueError("horizon is 1..365")


def linear(series: DataFrame, horizon: int = 7) -> DataFrame:
    """Least squares over the day number, continued and clipped at 0."""
    _check(horizon)
    day = F.unix_date("date").cast("double")
    line = series.agg(
        F.regr_slope("value", day).alias("slope"), F.regr_intercept("value", day).alias("base"), F.max("date").alias("last")
    )
    ahead = line.select("slope", "base", "last", F.explode(_future(horizon)).alias("i"))
    at = F.date_add("last", F.col("i"))
    fitted = F.col("base") + F.col("slope") * F.unix_date(at)
    return ahead.select(at.alias("date"), F.greatest(fitted, F.lit(0.0)).alias("value"))


def _last_week(series: DataFrame) -> DataFrame:
    """The last (up to) seven days with their place ``k`` counted back from 0."""
    back = W.orderBy(F.desc("date"))
    latest = series.orderBy(F.desc("date")).limit(_WEEK)
    return latest.withColumn("k", F.row_number().over(back) - 1)


def moving_average(series: DataFrame, horizon: int = 7) -> DataFrame:
    """The mean of the last seven days, repeated."""
    _check(horizon)
    mean = _last_week(series).agg(F.avg("value").alias("value"), F.max("date").alias("last"))
    ahead = mean.select("value", "last", F.explode(_future(horizon)).alias("i"))
    return ahead.select(F.date_add("last", F.col("i")).alias("date"), "value")


def seasonal_naive(series: DataFrame, horizon: int = 7) -> DataFrame:
    """The last week again and again, clipped at 0."""
    _check(horizon)
    cycle = _last_week(series).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("date", "value"))), lambda d: d.getField("value")).alias("cycle"),
        F.max("date").alias("last"),
    )
    ahead = cycle.select("cycle", "last", F.explode(_future(horizon)).alias("i"))
    value = F.get("cycle", (F.col("i") - 1) % F.size("cycle"))
    return ahead.select(F.date_add("last", F.col("i")).alias("date"), F.greatest(value, F.lit(0.0)).alias("value"))


def forecast(
    df: DataFrame, date_column: str | None = None, target: str | None = None, method: str = "linear", horizon: int = 7
) -> DataFrame:
    """``(kind, date, value)``: the daily history and its continuation. Needs two days at least."""
    date_column = date_column or infer_date_column(df)
    if not date_column:
        raise ValueError("no date column found; name one")
    method = method.lower()
    if method not in METHODS:
        raise ValueError(f"unknown method '{method}'; one of {', '.join(METHODS)}")
    series = daily_series(df, date_column, target)
    if len(series.head(2)) < 2:
        raise ValueError("a forecast needs at least two days with readable dates")
    make = {"linear": linear, "moving_average": moving_average, "seasonal_naive": seasonal_naive}[method]
    history = series.select(F.lit("historical").alias("kind"), "date", "value")
    return history.unionByName(make(series, horizon).select(F.lit("forecast").alias("kind"), "date", "value"))
