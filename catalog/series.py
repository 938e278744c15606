"""Daily series and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.tables import table
from tablesmith.operators import forecast


def _daily(value: str, table_name: str, ts: str) -> str:
    return f"""d AS (SELECT CAST({ts} AS DATE) AS date, CAST({value} AS DOUBLE) AS value FROM {table_name} WHERE {ts} IS NOT NULL GROUP BY 1),
s AS (SELECT CAST(c.date AS DATE) AS date, coalesce(value, 0) AS value FROM (SELECT unnest(generate_series((SELECT min(date) FROM d), (SELECT max(date) FROM d), INTERVAL 1 DAY)) AS date) c LEFT JOIN d ON CAST(c.date AS DATE) = d.date)"""


_EVENTS = _daily("sum(value)", "events", "ts")
_ORDERS = _daily("count(*)", "null_orders", "o_orderdate")


def _events(spark, sf):
    return forecast.daily_series(table(spark, sf, "events"), "ts", "value")


def _rounded(df):
    return df.withColumn("value", F.round("value", 4))


@query("daily_series", f"WITH {_EVENTS} SELECT date, round(value, 4) AS value FROM s")
def daily_series(spark, sf):
    return _rounded(_events(spark, sf))


@query("daily_counts", f"WITH {_ORDERS} SELECT date, value FROM s")
def daily_counts(spark, sf):
    return forecast.daily_series(table(spark, sf, "null_orders"), "o_orderdate")


@query("daily_text_dates", "SELECT CAST(c.date AS DATE) AS date, CAST(coalesce(n, 0) AS DOUBLE) AS value FROM (SELECT unnest(generate_series(DATE '2023-01-15', DATE '2023-02-28', INTERVAL 1 DAY)) AS date) c LEFT JOIN (SELECT CAST(coalesce(try_strptime(signup_date, '%Y-%m-%d'), try_strptime(signup_date, '%m/%d/%Y')) AS DATE) AS date, count(*) AS n FROM dirty_customer GROUP BY 1) d ON CAST(c.date AS DATE) = d.date")
def daily_text_dates(spark, sf):
    return forecast.daily_series(table(spark, sf, "dirty_customer"), "signup_date", "name")


_AHEAD = "(SELECT unnest(range(1, 15)) AS i)"
_LINEAR = "SELECT CAST(last + CAST(i AS INTEGER) AS DATE) AS date, greatest(base + slope * (datediff('day', DATE '1970-01-01', last) + i), 0) AS value FROM (SELECT regr_slope(value, datediff('day', DATE '1970-01-01', date)) AS slope, regr_intercept(value, datediff('day', DATE '1970-01-01', date)) AS base, max(date) AS last FROM s), " + _AHEAD


@query("forecast_linear", f"WITH {_EVENTS} SELECT date, round(value, 4) AS value FROM ({_LINEAR})")
def forecast_linear(spark, sf):
    return _rounded(forecast.linear(_events(spark, sf), 14))


@query("forecast_ma", f"WITH {_EVENTS} SELECT CAST(last + CAST(i AS INTEGER) AS DATE) AS date, round(value, 4) AS value FROM (SELECT avg(value) AS value, max(date) AS last FROM (SELECT * FROM s ORDER BY date DESC LIMIT 7)), {_AHEAD}")
def forecast_ma(spark, sf):
    return _rounded(forecast.moving_average(_events(spark, sf), 14))


_SEASONAL = f"SELECT CAST(l.last + CAST(i AS INTEGER) AS DATE) AS date, greatest(value, 0) AS value FROM {_AHEAD}, (SELECT max(date) AS last FROM s) l, (SELECT value, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT * FROM s ORDER BY date DESC LIMIT 7)) w WHERE k = (i - 1) % 7"


@query("forecast_seasonal", f"WITH {_EVENTS} SELECT date, round(value, 4) AS value FROM ({_SEASONAL})")
def forecast_seasonal(spark, sf):
    return _rounded(forecast.seasonal_naive(_events(spark, sf), 14))


@query("forecast_full", f"WITH {_ORDERS} SELECT 'historical' AS kind, date, value FROM s UNION ALL SELECT 'forecast', date, value FROM ({_SEASONAL})")
def forecast_full(spark, sf):
    return forecast.forecast(table(spark, sf, "null_orders"), "o_orderdate", method="seasonal_naive", horizon=14)
