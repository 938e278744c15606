"""Histogram, value counts, correlation, grouped aggregates, overview."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.tables import table
from tablesmith.operators import analytics


def _histogram_sql(table_name: str, column: str, bins: int) -> str:
    return f"""WITH b AS (SELECT CAST(min({column}) AS DOUBLE) AS lo, CAST(max({column}) AS DOUBLE) AS hi FROM {table_name}),
w AS (SELECT lo, hi, (hi - lo) / {bins} AS step FROM b),
g AS (SELECT CAST({column} AS DOUBLE) AS x, lo, step, least(CAST(floor((CAST({column} AS DOUBLE) - lo) / (hi - lo) * {bins}.0::DOUBLE) AS BIGINT), {bins - 1}) AS i FROM {table_name}, w WHERE {column} IS NOT NULL),
p AS (SELECT CASE WHEN x < lo + i * step THEN i - 1 WHEN i < {bins - 1} AND x >= lo + (i + 1) * step THEN i + 1 ELSE i END AS i FROM g)
SELECT r.i AS bin_index, round_even(lo + r.i * step, 2) AS bin, (SELECT count(*) FROM p WHERE p.i = r.i) AS n FROM (SELECT unnest(range({bins})) AS i) r, w"""


@query("histogram", _histogram_sql("lineitem", "l_quantity", 20))
def histogram(spark, sf):
    return analytics.histogram(table(spark, sf, "lineitem"), "l_quantity")


@query("histogram_spiked", _histogram_sql("null_orders", "o_totalprice", 50))
def histogram_spiked(spark, sf):
    return analytics.histogram(table(spark, sf, "null_orders"), "o_totalprice", bins=50)


@query("value_counts", "SELECT l_partkey AS name, count(*) AS value FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def value_counts(spark, sf):
    return analytics.value_counts(table(spark, sf, "lineitem"), "l_partkey")


_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_CELLS = " UNION ALL ".join(
    f"SELECT '{x}' AS x, '{y}' AS y, round_even(corr({x}, {y}), 3) + 0.0 AS value FROM lineitem"
    for x in _NUMERIC
    for y in _NUMERIC
)


@query("correlation_matrix", _CELLS)
def correlation_matrix(spark, sf):
    return analytics.correlation(table(spark, sf, "lineitem").drop("l_returnflag"))


_AGGREGATES = {
    "sum": "round(coalesce(sum(o_totalprice), 0), 2)",
    "mean": "round(avg(o_totalprice), 4)",
    "median": "round(quantile_cont(o_totalprice, 0.5), 4)",
    "min": "min(o_totalprice)",
    "max": "max(o_totalprice)",
    "count": "count(o_totalprice)",
    "nunique": "count(DISTINCT o_totalprice)",
    "std": "round(stddev_samp(o_totalprice), 4)",
    "var": "round(var_samp(o_totalprice) / 1e6, 4)",
    "size": "count(*)",
    "first": "arg_min(o_totalprice, row_id) FILTER (o_totalprice IS NOT NULL)",
    "last": "arg_max(o_totalprice, row_id) FILTER (o_totalprice IS NOT NULL)",
}


def _register(agg: str, sql: str) -> None:
    @query(
        f"agg_{agg}",
        f"SELECT o_custkey AS name, {sql} AS value FROM null_orders WHERE o_custkey IS NOT NULL GROUP BY 1 ORDER BY value DESC NULLS LAST, 1 LIMIT 20",
    )
    def run(spark, sf):
        out = analytics.aggregate(table(spark, sf, "null_orders"), "o_custkey", "o_totalprice", agg, row_id="row_id")
        if agg in ("sum", "mean", "median", "std"):
            return out.withColumn("value", F.round("value", 2 if agg == "sum" else 4))
        return out.withColumn("value", F.round(F.col("value") / 1e6, 4)) if agg == "var" else out


for _agg, _sql in _AGGREGATES.items():
    _register(_agg, _sql)


@query("agg_prod", "SELECT l_returnflag AS name, round(product(1 + l_tax / 10000), 6) AS value FROM lineitem GROUP BY 1")
def agg_prod(spark, sf):
    items = table(spark, sf, "lineitem").select("l_returnflag", (1 + F.col("l_tax") / 10000).alias("factor"))
    out = analytics.aggregate(items, "l_returnflag", "factor", "prod")
    return out.withColumn("value", F.round("value", 6))


@query("agg_median_hot_groups", "SELECT l_returnflag AS name, round(quantile_cont(l_extendedprice, 0.5), 4) AS value FROM lineitem GROUP BY 1")
def agg_median_hot_groups(spark, sf):
    out = analytics.aggregate(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", "median")
    return out.withColumn("value", F.round("value", 4))


@query("overview_kpis", 'SELECT count(*) AS "rows", CAST(13 AS BIGINT) AS columns, CAST(3 AS BIGINT) AS numeric_columns, CAST(10 AS BIGINT) AS categorical_columns FROM dirty_customer')
def overview_kpis(spark, sf):
    return analytics.overview_kpis(table(spark, sf, "dirty_customer"))


@query("overview_breakdown", "SELECT o_orderstatus AS name, count(*) AS value FROM orders GROUP BY 1")
def overview_breakdown(spark, sf):
    return analytics.overview(table(spark, sf, "orders"))["category_breakdown"]
