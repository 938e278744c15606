"""Joins of two tables."""

from __future__ import annotations

from catalog import query
from catalog.tables import table
from tablesmith.operators import joins


def _orders(spark, sf):
    return table(spark, sf, "null_orders").select("row_id", "o_custkey", "o_totalprice")


def _customers(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")


@query("join_inner", "SELECT * FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, sf):
    return joins.join_datasets(table(spark, sf, "orders"), table(spark, sf, "customer"), "o_custkey", "c_custkey")


@query("join_left", "SELECT row_id, o_custkey, o_totalprice, c_custkey, c_name, c_acctbal FROM null_orders LEFT JOIN customer ON o_custkey IS NOT DISTINCT FROM c_custkey")
def join_left(spark, sf):
    return joins.join_datasets(_orders(spark, sf), _customers(spark, sf), "o_custkey", "c_custkey", "left")


@query("join_right", "SELECT row_id, o_custkey, o_totalprice, c_custkey, c_name, c_acctbal FROM null_orders RIGHT JOIN customer ON o_custkey IS NOT DISTINCT FROM c_custkey")
def join_right(spark, sf):
    return joins.join_datasets(_orders(spark, sf), _customers(spark, sf), "o_custkey", "c_custkey", "right")


@query("join_outer", "SELECT coalesce(o.o_custkey, c.c_custkey) AS key, row_id, c_name FROM null_orders o FULL JOIN customer c ON o.o_custkey = c.c_custkey")
def join_outer(spark, sf):
    left = _orders(spark, sf).selectExpr("o_custkey AS key", "row_id")
    right = _customers(spark, sf).selectExpr("c_custkey AS key", "c_name")
    return joins.join_datasets(left, right, "key", "key", "outer")


@query("join_null_keys", "WITH l AS (SELECT o_orderstatus AS status, min(row_id) AS first_row FROM null_orders GROUP BY 1), r AS (SELECT o_orderstatus AS status, count(*) AS n FROM null_orders GROUP BY 1) SELECT l.status AS status, first_row, n FROM l JOIN r ON l.status IS NOT DISTINCT FROM r.status")
def join_null_keys(spark, sf):
    orders = table(spark, sf, "null_orders")
    left = orders.groupBy("o_orderstatus").agg({"row_id": "min"}).toDF("status", "first_row")
    right = orders.groupBy("o_orderstatus").count().toDF("status", "n")
    return joins.join_datasets(left, right, "status", "status")


@query("join_suffixes", "SELECT a.c_custkey AS id, a.c_name AS name_left, a.c_acctbal AS balance, b.s_name AS name_right, b.s_acctbal AS balance_2 FROM customer a JOIN supplier b ON a.c_custkey = b.s_suppkey")
def join_suffixes(spark, sf):
    left = table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal AS balance")
    right = table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS balance_2")
    return joins.join_datasets(left, right, "id", "id", suffixes=("_left", "_right"))


@query("join_summary", "SELECT (SELECT count(*) FROM orders) AS left_rows, (SELECT count(*) FROM customer) AS right_rows, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) AS result_rows")
def join_summary(spark, sf):
    left, right = table(spark, sf, "orders"), table(spark, sf, "customer")
    return joins.join_summary(left, right, joins.join_datasets(left, right, "o_custkey", "c_custkey"))
