"""Fills, outlier removal, normalisation, the default cleaning pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.tables import table
from tablesmith.operators import fill, scale
from tablesmith.plans import registry


def _rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


@query("fill_mean", "SELECT row_id, o_custkey, o_orderstatus, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM null_orders)), 4) AS o_totalprice FROM null_orders")
def fill_mean(spark, sf):
    view = table(spark, sf, "null_orders").select("row_id", "o_custkey", "o_orderstatus", "o_totalprice")
    return _rounded(fill.fill_missing(view, "mean", ["o_totalprice", "o_orderstatus"]), ["o_totalprice"], 4)


@query("fill_mean_keeps_int", "SELECT row_id, CAST(row_id AS BIGINT) + 9007199254740993 AS big FROM null_orders")
def fill_mean_keeps_int(spark, sf):
    """A column without gaps keeps its type and every digit."""
    view = table(spark, sf, "null_orders").selectExpr("row_id", "CAST(row_id AS BIGINT) + 9007199254740993 AS big")
    return fill.fill_missing(view, "mean", ["big"])


@query("fill_median", "SELECT row_id, round(coalesce(o_custkey, (SELECT quantile_cont(CAST(o_custkey AS DOUBLE), 0.5) FROM null_orders)), 4) AS o_custkey, round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM null_orders)), 4) AS o_totalprice FROM null_orders")
def fill_median(spark, sf):
    view = table(spark, sf, "null_orders").select("row_id", "o_custkey", "o_totalprice")
    return _rounded(fill.fill_missing(view, "median", ["o_custkey", "o_totalprice"]), ["o_custkey", "o_totalprice"], 4)


@query("fill_mode", "SELECT row_id, coalesce(o_orderstatus, (SELECT o_orderstatus FROM null_orders WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderstatus, coalesce(o_custkey, (SELECT o_custkey FROM null_orders WHERE o_custkey IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_custkey FROM null_orders")
def fill_mode(spark, sf):
    view = table(spark, sf, "null_orders").select("row_id", "o_orderstatus", "o_custkey")
    return fill.fill_missing(view, "mode", ["o_orderstatus", "o_custkey"])


@query("fill_ffill", "SELECT row_id, last_value(o_custkey IGNORE NULLS) OVER w AS o_custkey, last_value(o_orderstatus IGNORE NULLS) OVER w AS o_orderstatus, last_value(o_totalprice IGNORE NULLS) OVER w AS o_totalprice FROM null_orders WINDOW w AS (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def fill_ffill(spark, sf):
    view = table(spark, sf, "null_orders").select("row_id", "o_custkey", "o_orderstatus", "o_totalprice")
    return fill.fill_missing(view, "ffill", row_id="row_id", slice_rows=2_000)


@query("fill_bfill", "SELECT row_id, first_value(o_custkey IGNORE NULLS) OVER w AS o_custkey, first_value(o_orderstatus IGNORE NULLS) OVER w AS o_orderstatus, first_value(o_totalprice IGNORE NULLS) OVER w AS o_totalprice FROM null_orders WINDOW w AS (ORDER BY row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
def fill_bfill(spark, sf):
    view = table(spark, sf, "null_orders").select("row_id", "o_custkey", "o_orderstatus", "o_totalprice")
    return fill.fill_missing(view, "bfill", row_id="row_id", slice_rows=2_000)


@query("fill_constant", "SELECT row_id, coalesce(o_custkey, -1) AS o_custkey, coalesce(o_totalprice, -1) AS o_totalprice, o_orderpriority FROM null_orders")
def fill_constant(spark, sf):
    view = table(spark, sf, "null_orders").select("row_id", "o_custkey", "o_totalprice", "o_orderpriority")
    return fill.fill_missing(view, "constant", ["o_custkey", "o_totalprice"], value=-1)


_IQR = """WITH b AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM null_orders)
SELECT n.* FROM null_orders n, b WHERE o_totalprice IS NULL OR o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"""


@query("outliers_iqr_removed", _IQR)
def outliers_iqr_removed(spark, sf):
    return scale.remove_outliers(table(spark, sf, "null_orders"), "iqr", ["o_totalprice"])


@query("outliers_z_removed", """WITH b AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM null_orders)
SELECT n.* FROM null_orders n, b WHERE o_totalprice IS NULL OR abs((o_totalprice - m) / s) <= 3""")
def outliers_z_removed(spark, sf):
    return scale.remove_outliers(table(spark, sf, "null_orders"), "zscore", ["o_totalprice"])


@query("normalize_minmax", """WITH b AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, min(c_nationkey) AS nlo, max(c_nationkey) AS nhi FROM customer)
SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 9) AS c_acctbal, round(CAST(c_nationkey - nlo AS DOUBLE) / (nhi - nlo), 9) AS c_nationkey FROM customer, b""")
def normalize_minmax(spark, sf):
    view = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return _rounded(scale.normalize(view, "minmax", ["c_acctbal", "c_nationkey"]), ["c_acctbal", "c_nationkey"], 9)


@query("normalize_standard", """WITH b AS (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s, avg(l_discount) AS dm, stddev_pop(l_discount) AS ds FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_extendedprice - m) / s, 6) AS l_extendedprice, round((l_discount - dm) / ds, 6) AS l_discount FROM lineitem, b""")
def normalize_standard(spark, sf):
    view = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    cols = ["l_extendedprice", "l_discount"]
    return _rounded(scale.normalize(view, "standard", cols), cols, 6)


_AUTO = r"""WITH d AS (SELECT DISTINCT o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM null_orders),
t AS (SELECT o_custkey, trim(o_orderstatus) AS o_orderstatus, o_totalprice, trim(o_orderpriority) AS o_orderpriority FROM d)
SELECT round(coalesce(o_custkey, (SELECT quantile_cont(CAST(o_custkey AS DOUBLE), 0.5) FROM t)), 4) AS o_custkey,
 coalesce(o_orderstatus, (SELECT o_orderstatus FROM t WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderstatus,
 round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM t)), 4) AS o_totalprice, o_orderpriority FROM t"""


@query("auto_clean", _AUTO)
def auto_clean(spark, sf):
    view = table(spark, sf, "null_orders").select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return _rounded(registry.auto_clean(view), ["o_custkey", "o_totalprice"], 4)


@query("operation_pipeline", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue, l_returnflag AS flag FROM lineitem WHERE l_quantity > 25 AND l_returnflag <> 'N'")
def operation_pipeline(spark, sf):
    steps = [
        ("filter_rows", {"column": "l_quantity", "op": ">", "value": "25"}),
        ("filter_rows", {"column": "l_returnflag", "op": "!=", "value": "N"}),
        ("formula_column", {"expression": "l_extendedprice * (1 - l_discount)", "new": "revenue"}),
        ("rename_column", {"old": "l_returnflag", "new": "flag"}),
        ("drop_columns", {"columns": ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate"]}),
    ]
    return registry.apply_operations(table(spark, sf, "lineitem"), steps)
