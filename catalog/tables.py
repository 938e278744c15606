"""The given tables and the dirty views derived from them.

The given customer, orders and page tables hold no nulls and no bad values. Each view text
adds them and runs unchanged in Spark SQL and in the checking SQL engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_VIEWS = {
    "dirty_customer": (
        "customer",
        """SELECT c_custkey AS row_id,
  CASE c_custkey % 5 WHEN 0 THEN concat('  ', lower(c_name), ' ') WHEN 1 THEN upper(c_name) WHEN 2 THEN 'ada lovelace' ELSE c_name END AS name,
  CASE c_custkey % 7 WHEN 0 THEN 'not-an-email' WHEN 1 THEN concat('u', CAST(c_custkey AS STRING), '@@example.com') WHEN 2 THEN concat('u', CAST(c_custkey AS STRING), ' @example.com') WHEN 3 THEN concat('u', CAST(c_custkey AS STRING), '@example') WHEN 4 THEN NULL ELSE concat('u', CAST(c_custkey AS STRING), '@example.com') END AS email,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(18 + c_custkey % 60 AS INT) END AS age,
  CASE c_custkey % 6 WHEN 0 THEN 'M' WHEN 1 THEN 'female' WHEN 2 THEN 'F' WHEN 3 THEN 'man' WHEN 4 THEN 'n/a' ELSE 'Other' END AS gender,
  CASE c_custkey % 5 WHEN 0 THEN 'usa' WHEN 1 THEN 'U.K.' WHEN 2 THEN 'Deutschland' WHEN 3 THEN 'unknown' ELSE 'France' END AS country,
  CASE c_custkey % 4 WHEN 0 THEN concat('+1 (555) 010-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')) WHEN 1 THEN concat('555.123.', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')) WHEN 2 THEN '12345' ELSE NULL END AS phone,
  CASE c_custkey % 3 WHEN 0 THEN '12 main st, springfield, ca' WHEN 1 THEN '4  oak ave' ELSE 'PO Box 7' END AS address,
  CASE c_custkey % 4 WHEN 0 THEN '2023-01-15' WHEN 1 THEN '02/28/2023' WHEN 2 THEN 'never' ELSE NULL END AS signup_date,
  CASE c_custkey % 3 WHEN 0 THEN 'www.example.com' WHEN 1 THEN 'example.org/x' ELSE 'https://example.net' END AS website,
  CASE WHEN c_custkey % 13 = 0 THEN 'n/a' ELSE CAST(c_custkey * 3 AS STRING) END AS score_text,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END AS salary,
  c_mktsegment AS segment
FROM customer""",
    ),
    "null_orders": (
        "orders",
        """SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 500 = 1 THEN o_totalprice * 20 ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate, o_orderpriority
FROM orders""",
    ),
    "blank_parts": (
        "part",
        """SELECT p_partkey AS row_id, CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE p_name END AS a, CASE WHEN p_partkey % 50 = 0 THEN '  ' ELSE p_brand END AS b,
  CASE WHEN p_partkey % 25 = 0 THEN NULL ELSE p_size END AS c FROM part""",
    ),
    "dirty_pages": (
        "pages",
        """SELECT page_id AS row_id, CASE page_id % 3 WHEN 0 THEN replace(replace(url, 'https://', ''), 'http://', '')
  WHEN 1 THEN concat('www.', replace(replace(url, 'https://', ''), 'http://', '')) ELSE url END AS url FROM pages""",
    ),
    # texts with tabs and blank runs at the edges, all white space being ASCII
    "spaced_parts": (
        "part",
        """SELECT p_partkey AS row_id, concat('  ', p_name, chr(9), p_type, '  ') AS label, p_brand AS brand FROM part""",
    ),
    # prices as people write them
    "priced_parts": (
        "part",
        """SELECT p_partkey AS row_id, concat('$', CAST(CAST(p_partkey * 7 AS BIGINT) AS STRING), ',250.5') AS price_text,
  concat(CAST(p_size AS STRING), ' %') AS share_text,
  CASE WHEN p_size % 10 = 0 THEN 'n/a' ELSE concat('-', CAST(p_size AS STRING), '.75') END AS size_text FROM part""",
    ),
    # rows that repeat by themselves: few copies, and more than the removal guard allows
    "few_copies": ("lineitem", "SELECT l_orderkey, l_partkey FROM lineitem"),
    "many_copies": ("documents", "SELECT text, lang FROM documents"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a dirty view over one."""
    if name in _VIEWS:
        base, text = _VIEWS[name]
        text = re.sub(rf"FROM {base}$", f"FROM {{{base}}}", text)
        return spark.sql(text, **{base: table(spark, sf_dir, base)})
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def with_views(sql: str) -> str:
    """Prefix a checking query with the views it names."""
    used = [v for v in _VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    views = ",\n".join(f"{v} AS ({_VIEWS[v][1]})" for v in used)
    if sql.lstrip()[:5].upper() == "WITH ":
        return f"WITH {views},\n{sql.lstrip()[5:]}"
    return f"WITH {views}\n{sql}"
