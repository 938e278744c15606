"""SQL workspace: one query per shape a SELECT can take."""

from __future__ import annotations

from catalog import query
from catalog.tables import table
from tablesmith.plans import sqlspace

_TABLES = ("customer", "orders", "lineitem", "nation", "region", "supplier", "part", "events")


def _register(name: str, sql: str, twin: str | None = None, base: str = "orders", oracle: bool = True) -> None:
    @query(name, (twin or sql) if oracle else None)
    def run(spark, sf):
        tables = {t: table(spark, sf, t) for t in _TABLES if t in sql}
        return sqlspace.query(table(spark, sf, base), sql, name=base, tables=tables)


@query("sql_group_count", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC LIMIT 1000")
def sql_group_count(spark, sf):
    text = "SELECT o_orderstatus, count(*) AS n FROM data GROUP BY o_orderstatus ORDER BY n DESC;"
    return sqlspace.run_sql(table(spark, sf, "orders"), text, name="My Orders 2024")


@query("sql_by_name", "SELECT o_orderpriority, min(o_totalprice) AS low FROM orders GROUP BY 1")
def sql_by_name(spark, sf):
    text = "SELECT o_orderpriority, min(o_totalprice) AS low FROM my_orders_2024 GROUP BY o_orderpriority"
    return sqlspace.run_sql(table(spark, sf, "orders"), text, name="My Orders (2024)")


@query("sql_truncated", "SELECT count(*) AS row_count, count(*) > 100000 AS truncated, CAST(100000 AS BIGINT) AS \"limit\" FROM orders WHERE o_orderstatus = 'F'")
def sql_truncated(spark, sf):
    result = sqlspace.query(table(spark, sf, "orders"), "SELECT * FROM dataset WHERE o_orderstatus = 'F'")
    return sqlspace.result_summary(result, limit=100_000)


_register("sql_join_kinds", """WITH i AS (SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey),
 l AS (SELECT count(*) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'),
 r AS (SELECT count(*) AS n FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'P'),
 f AS (SELECT count(*) AS n FROM (SELECT * FROM orders WHERE o_orderstatus = 'P') o FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey),
 x AS (SELECT count(*) AS n FROM orders CROSS JOIN (SELECT avg(o_totalprice) AS mean FROM orders) WHERE o_totalprice > mean)
 SELECT 'inner' AS kind, n FROM i UNION ALL SELECT 'left', n FROM l UNION ALL SELECT 'right', n FROM r UNION ALL SELECT 'full', n FROM f UNION ALL SELECT 'cross', n FROM x""")
_register("sql_semi", "SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000",
          "SELECT c_custkey, c_name FROM customer SEMI JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey")
_register("sql_anti", "SELECT c_custkey, c_name FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000",
          "SELECT c_custkey, c_name FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey")
_register("sql_range_join", "SELECT band, count(*) AS n FROM lineitem JOIN (VALUES ('low', 0, 10), ('mid', 10, 30), ('high', 30, 60)) AS b(band, lo, hi) ON l_quantity >= lo AND l_quantity < hi GROUP BY band")
_register("sql_having", "SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderstatus) AS kinds, count(*) FILTER (WHERE o_orderstatus = 'F') AS final FROM orders GROUP BY o_custkey HAVING count(*) >= 10")
_register("sql_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
_register("sql_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_register("sql_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_extendedprice) AS low FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
_register("sql_window_rank", "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS place, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS line, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS earlier FROM orders",
          "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS INTEGER) AS place, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS line, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS earlier FROM orders")
_register("sql_window_frame", "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS best_of_three, lead(o_orderkey, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next_order FROM orders")
_register("sql_set_ops", "SELECT 'union' AS op, c_nationkey AS k FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersect', c_nationkey FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except', c_custkey FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)",
          "SELECT 'union' AS op, CAST(c_nationkey AS BIGINT) AS k FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersect', c_nationkey FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except', c_custkey FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
_register("sql_cte", "WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), top AS (SELECT * FROM spend WHERE total > (SELECT avg(total) FROM spend)) SELECT c_mktsegment, count(*) AS n FROM top JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
_register("sql_correlated", "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000) AND c_acctbal > (SELECT avg(c2.c_acctbal) FROM customer c2 WHERE c2.c_nationkey = c.c_nationkey)")
_register("sql_scalars", "SELECT event_id, upper(event_type) AS kind, length(props) AS size, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, year(ts) AS y, month(ts) AS m, CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS hour, round(sqrt(abs(value)), 6) AS root, CASE WHEN value > 10 THEN 'big' ELSE 'small' END AS band FROM events",
          "SELECT event_id, upper(event_type) AS kind, CAST(length(props) AS INTEGER) AS size, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, date_trunc('hour', ts) AS hour, round(sqrt(abs(value)), 6) AS root, CASE WHEN value > 10 THEN 'big' ELSE 'small' END AS band FROM events")
_register("sql_approx_distinct", "SELECT approx_count_distinct(l_partkey) AS parts FROM lineitem", oracle=False)
_register("sql_approx_distinct_bound", "SELECT o_orderpriority, abs(approx_count_distinct(o_custkey) - count(DISTINCT o_custkey)) <= 0.15 * count(DISTINCT o_custkey) AS within FROM orders GROUP BY o_orderpriority",
          "SELECT o_orderpriority, true AS within FROM orders GROUP BY o_orderpriority")
_register("sql_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
