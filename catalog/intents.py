"""Routing of messages to operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.tables import table
from tablesmith.plans import intents

_ACTION = """CASE WHEN regexp_matches(lower(text), 'remove duplicate|drop duplicate|deduplicate') THEN 'remove_duplicates'
 WHEN regexp_matches(lower(text), 'missing|null|fill') AND regexp_matches(lower(text), 'drop|remove') THEN 'drop_nulls' WHEN regexp_matches(lower(text), 'missing|null|fill') THEN 'auto_fill'
 WHEN regexp_matches(lower(text), 'outlier|anomal') THEN 'remove_outliers' WHEN regexp_matches(lower(text), 'correlation|correlate') THEN 'correlation'
 WHEN regexp_matches(lower(text), 'summary|describe|explain|overview') THEN 'profile' WHEN regexp_matches(lower(text), 'bar chart|top') THEN 'value_counts'
 WHEN regexp_matches(lower(text), 'histogram|distribution') THEN 'histogram' ELSE 'help' END"""
# requests derived from the orders: their priority picks the wording
_REQUESTS = """CASE o_orderpriority WHEN '1-URGENT' THEN 'Please REMOVE duplicates' WHEN '2-HIGH' THEN 'drop rows with missing ' || o_orderstatus WHEN '3-MEDIUM' THEN 'show the top o_orderstatus'
 WHEN '4-NOT SPECIFIED' THEN 'Histogram of o_totalprice for order ' || CAST(o_orderkey AS STRING) ELSE 'find outliers' END"""


@query("route_intents", f"SELECT conv_id, turn, {_ACTION} AS action FROM conversations")
def route_intents(spark, sf):
    return intents.route_intents(table(spark, sf, "conversations"), "text").select("conv_id", "turn", "action")


@query("route_requests", f"SELECT o_orderkey, action, CASE action WHEN 'drop_nulls' THEN 'any' WHEN 'remove_outliers' THEN 'iqr' WHEN 'value_counts' THEN 'o_orderstatus' WHEN 'histogram' THEN 'o_totalprice' END AS param FROM (SELECT o_orderkey, {_ACTION} AS action FROM (SELECT o_orderkey, {_REQUESTS} AS text FROM orders))")
def route_requests(spark, sf):
    orders = table(spark, sf, "orders")
    messages = orders.selectExpr("o_orderkey", f"{_REQUESTS} AS text")
    out = intents.route_intents(messages, "text", schema=orders)
    value = F.coalesce(F.col("params")["how"], F.col("params")["method"], F.col("params")["column"])
    return out.select("o_orderkey", "action", value.alias("param"))


@query("route_column", "SELECT doc_id, CASE WHEN contains(lower(text), 'on') THEN 'on' WHEN contains(lower(text), 'the') THEN 'The' WHEN contains(lower(text), 'un') THEN 'un' END AS named FROM documents")
def route_column(spark, sf):
    named = intents.find_column(F.col("text"), ["on", "The", "un"])
    return table(spark, sf, "documents").select("doc_id", named.alias("named"))
