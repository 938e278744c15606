"""Outlier report, column statistics, profile, semantic types, quality scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.tables import table
from tablesmith.operators.quantiles import exact_quantiles
from tablesmith.plans import outliers, profile, sketches
from tablesmith.session import scratch_path
from tablesmith.operators.values import duplicate_rows, value_summary


def _outlier_sql(table_name: str, columns: list[str]) -> str:
    def one(c: str) -> str:
        return f"""SELECT '{c}' AS "column",
 count(*) FILTER (iqr > 0 AND (x < q1 - 1.5 * iqr OR x > q3 + 1.5 * iqr)) AS iqr_count,
 CASE WHEN max(iqr) > 0 THEN round(max(q1 - 1.5 * iqr), 6) END AS iqr_low,
 CASE WHEN max(iqr) > 0 THEN round(max(q3 + 1.5 * iqr), 6) END AS iqr_high,
 count(*) FILTER (s > 0 AND abs((x - m) / s) > 3) AS zscore_count,
 count(*) FILTER (mad > 0 AND abs(0.6745 * (x - med) / mad) > 3.5) AS modified_zscore_count,
 count(*) FILTER ((iqr > 0 AND (x < q1 - 1.5 * iqr OR x > q3 + 1.5 * iqr)) OR (s > 0 AND abs((x - m) / s) > 3) OR (mad > 0 AND abs(0.6745 * (x - med) / mad) > 3.5)) AS total_unique
FROM (SELECT CAST({c} AS DOUBLE) AS x, f.* FROM {table_name},
 (SELECT b.*, q3 - q1 AS iqr, (SELECT quantile_cont(abs(CAST({c} AS DOUBLE) - b.med), 0.5) FROM {table_name}) AS mad FROM
  (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS med, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3,
   avg({c}) AS m, stddev_pop({c}) AS s FROM {table_name}) b) f)"""

    return "\nUNION ALL\n".join(one(c) for c in columns)


@query("outlier_report", _outlier_sql("null_orders", ["o_totalprice", "o_custkey"]))
def outlier_report(spark, sf):
    return outliers.outlier_report(table(spark, sf, "null_orders"), ["o_totalprice", "o_custkey"], digits=6)


@query("outlier_report_lineitem", _outlier_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def outlier_report_lineitem(spark, sf):
    return outliers.outlier_report(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], digits=6)


def _numeric_stats_sql(table_name: str, columns: dict[str, str]) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS name, '{t}' AS dtype, count(*) FILTER ({c} IS NULL) AS missing,
 round_even(100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*), 2) AS missing_pct, count(DISTINCT {c}) AS "unique",
 CAST(min({c}) AS DOUBLE) AS "min", CAST(max({c}) AS DOUBLE) AS "max", round_even(avg({c}), 4) AS mean, round_even(stddev_samp({c}), 4) AS std,
 quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median, CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS top_count FROM {table_name}"""
        for c, t in columns.items()
    )


@query("column_stats_numeric", _numeric_stats_sql("lineitem", {"l_orderkey": "integer", "l_partkey": "integer", "l_linenumber": "integer", "l_quantity": "float", "l_extendedprice": "float", "l_discount": "float"}))
def column_stats_numeric(spark, sf):
    return profile.column_stats(
        table(spark, sf, "lineitem"),
        ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"],
    )


def _text_stats_sql(table_name: str, columns: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS name, 'string' AS dtype, count(*) FILTER ({c} IS NULL) AS missing,
 round_even(100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*), 2) AS missing_pct, count(DISTINCT {c}) AS "unique",
 CAST(NULL AS DOUBLE) AS "min", CAST(NULL AS DOUBLE) AS "max", CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS median,
 (SELECT {c} FROM {table_name} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top,
 (SELECT count(*) FROM {table_name} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) AS top_count FROM {table_name}"""
        for c in columns
    )


_APPROX = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"]


@query("column_stats_approx", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS name, count(*) FILTER ({c} IS NULL) AS missing, CAST(min({c}) AS DOUBLE) AS \"min\", CAST(max({c}) AS DOUBLE) AS \"max\", round_even(avg({c}), 2) AS mean, round_even(stddev_samp({c}), 2) AS std, true AS unique_within, true AS median_within FROM lineitem" for c in _APPROX))
def column_stats_approx(spark, sf):
    """Estimates of one pass, held against exact values: within the stated bounds for each column."""
    lines = table(spark, sf, "lineitem").select(*_APPROX)
    around = exact_quantiles(lines, _APPROX, [0.5 - sketches.RANK_ERROR, 0.5 + sketches.RANK_ERROR])
    within = [F.struct(F.lit(c).alias("name"), F.lit(float(around[c][0])).alias("low"), F.lit(float(around[c][1])).alias("high")) for c in _APPROX]
    bounds = lines.agg(*[F.count_distinct(c).alias(c) for c in _APPROX]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("exact")) for c in _APPROX])))
    ranks = spark.range(1).select(F.inline(F.array(*within)))
    near = F.abs(F.col("unique") - F.col("exact")) <= sketches.DISTINCT_ERROR * F.col("exact")
    joined = profile.column_stats(lines, approx=True).join(bounds, "name").join(ranks, "name")
    return joined.select("name", "missing", "min", "max", F.bround("mean", 2).alias("mean"), F.bround("std", 2).alias("std"), near.alias("unique_within"), F.col("median").between(F.col("low"), F.col("high")).alias("median_within"))


@query("column_stats_store", "SELECT 'o_totalprice' AS name, count(*) FILTER (o_totalprice IS NULL) AS missing, min(o_totalprice) AS \"min\", max(o_totalprice) AS \"max\", round_even(avg(o_totalprice), 2) AS mean FROM null_orders UNION ALL SELECT 'o_orderstatus', count(*) FILTER (o_orderstatus IS NULL), NULL, NULL, NULL FROM null_orders")
def column_stats_store(spark, sf):
    """Sketches for each file, brought up to date after an append, merged."""
    data, store, orders = scratch_path(spark, "sketched"), scratch_path(spark, "sketches"), table(spark, sf, "null_orders")
    names = ["o_totalprice", "o_orderstatus"]
    orders.where("row_id % 3 = 0").write.parquet(data)
    sketches.update_store(spark, data, store, names)
    orders.where("row_id % 3 <> 0").write.mode("append").parquet(data)
    found = sketches.estimate(sketches.merge_sketches(sketches.update_store(spark, data, store, names)))
    return found.select("name", "missing", "min", "max", F.bround("mean", 2).alias("mean"))


@query("column_stats_text", _text_stats_sql("dirty_customer", ["name", "email", "gender", "country", "phone", "signup_date", "segment"]))
def column_stats_text(spark, sf):
    names = ["name", "email", "gender", "country", "phone", "signup_date", "segment"]
    return profile.column_stats(table(spark, sf, "dirty_customer"), names)


@query("profile_summary", """SELECT count(*) AS "rows", CAST(2 AS BIGINT) AS columns, count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM null_orders)) AS duplicate_rows,
 count(*) FILTER (o_custkey IS NULL) + count(*) FILTER (o_orderstatus IS NULL) AS missing_cells,
 round_even(100.0::DOUBLE * (count(*) FILTER (o_custkey IS NULL) + count(*) FILTER (o_orderstatus IS NULL)) / (2 * count(*)), 2) AS missing_pct FROM null_orders""")
def profile_summary(spark, sf):
    return profile.profile_summary(table(spark, sf, "null_orders").select("o_custkey", "o_orderstatus"))


@query("profile_dataset_totals", """SELECT count(*) AS "rows", CAST(2 AS BIGINT) AS columns, 2 * count(*) AS total_cells, CAST(0 AS BIGINT) AS missing_cells, CAST(0 AS DOUBLE) AS missing_pct,
 count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_rows, round_even(100.0::DOUBLE * (count(*) - count(DISTINCT (l_orderkey, l_linenumber))) / count(*), 2) AS duplicate_pct FROM lineitem""")
def profile_dataset_totals(spark, sf):
    return profile.profile_totals(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))


@query("entropy", """SELECT 'segment' AS "column", round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM dirty_customer WHERE segment IS NOT NULL GROUP BY segment)
UNION ALL SELECT 'email', round(-sum(p * log2(p)), 6) FROM (SELECT count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM dirty_customer WHERE email IS NOT NULL GROUP BY email)""")
def entropy(spark, sf):
    values = value_summary(table(spark, sf, "dirty_customer"), ["segment", "email"])
    return values.select("column", F.round("entropy", 6).alias("entropy"))


@query("uniqueness", """SELECT 'l_partkey' AS "column", count(DISTINCT l_partkey) AS "unique", round(count(DISTINCT l_partkey)::DOUBLE / count(*), 9) AS ratio FROM lineitem
UNION ALL SELECT 'l_shipdate', count(DISTINCT l_shipdate), round(count(DISTINCT l_shipdate)::DOUBLE / count(*), 9) FROM lineitem""")
def uniqueness(spark, sf):
    values = value_summary(table(spark, sf, "lineitem"), ["l_partkey", "l_shipdate"])
    return values.select("column", "unique", F.round(F.col("unique") / F.col("non_null"), 9).alias("ratio"))


@query("duplicate_count", "SELECT count(*) AS \"rows\", CAST(count(*) - count(DISTINCT (l_orderkey, l_partkey)) AS BIGINT) AS duplicate_rows FROM few_copies")
def duplicate_count(spark, sf):
    return duplicate_rows(table(spark, sf, "few_copies"))


_SENTINELS = "('', ' ', 'nan', 'na', 'n/a', 'none', 'null', 'nil', 'missing', 'unknown', 'undefined', '?', '-', '_', '0', '0.0', '(blank)', '[blank]')"


def _sentinel_sql(table_name: str, columns: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", count({c}) AS known, count(*) FILTER (lower(trim(CAST({c} AS VARCHAR))) IN {_SENTINELS}) AS sentinels,
 coalesce(round(count(*) FILTER (lower(trim(CAST({c} AS VARCHAR))) IN {_SENTINELS})::DOUBLE / nullif(count({c}), 0), 9), 0) AS ratio FROM {table_name}"""
        for c in columns
    )


@query("sentinel_ratio", _sentinel_sql("dirty_customer", ["country", "gender", "score_text", "salary"]))
def sentinel_ratio(spark, sf):
    out = profile.sentinel_ratios(table(spark, sf, "dirty_customer"), ["country", "gender", "score_text", "salary"])
    return out.withColumn("ratio", F.round("ratio", 9))


@query("semantic_types", """SELECT * FROM (VALUES ('row_id'), ('name'), ('email'), ('gender'), ('country'), ('phone'), ('address'), ('signup_date'), ('website'), ('segment'), ('salary')) AS t("column"), LATERAL (
SELECT CASE "column" WHEN 'row_id' THEN 'id' WHEN 'name' THEN 'name' WHEN 'email' THEN 'email' WHEN 'gender' THEN 'gender' WHEN 'country' THEN
  CASE WHEN (SELECT avg(CASE WHEN lower(country) IN ('usa', 'u.k.', 'france') AND lower(country) <> 'u.k.' THEN 1.0 ELSE 0.0 END) FROM dirty_customer) >= 0.7 THEN 'country' ELSE 'categorical' END
 WHEN 'phone' THEN 'phone' WHEN 'address' THEN 'address' WHEN 'signup_date' THEN 'date' WHEN 'website' THEN 'url' WHEN 'segment' THEN 'categorical' ELSE 'numeric' END AS semantic_type)""")
def semantic_types(spark, sf):
    names = ["row_id", "name", "email", "gender", "country", "phone", "address", "signup_date", "website", "segment", "salary"]
    return profile.semantic_types(table(spark, sf, "dirty_customer"), names).select("column", "semantic_type")


@query("semantic_confidence", """SELECT 'url' AS "column", CAST(0.95 AS DOUBLE) AS confidence, round_even(CAST(0 AS DOUBLE), 4) AS date_parse_ratio UNION ALL
SELECT 'signup_date', 0.75, round_even(count(*) FILTER (coalesce(try_strptime(signup_date, '%Y-%m-%d'), try_strptime(signup_date, '%m/%d/%Y')) IS NOT NULL)::DOUBLE / count(signup_date), 4) FROM dirty_customer UNION ALL
SELECT 'score_text', round_even(count(*) FILTER (TRY_CAST(score_text AS DOUBLE) IS NOT NULL)::DOUBLE / count(score_text), 4), 0.0 FROM dirty_customer""")
def semantic_confidence(spark, sf):
    customers = profile.semantic_types(table(spark, sf, "dirty_customer"), ["signup_date", "score_text"])
    pages = profile.semantic_types(table(spark, sf, "pages"), ["url"])
    return customers.unionByName(pages).select("column", "confidence", "date_parse_ratio")


@query("date_parse_ratio", "SELECT 'signup_date' AS \"column\", round_even(count(*) FILTER (coalesce(try_strptime(signup_date, '%Y-%m-%d'), try_strptime(signup_date, '%m/%d/%Y')) IS NOT NULL)::DOUBLE / count(signup_date), 4) AS date_parse_ratio FROM dirty_customer")
def date_parse_ratio(spark, sf):
    return profile.semantic_types(table(spark, sf, "dirty_customer"), ["signup_date"]).select("column", "date_parse_ratio")


def _top(c: str) -> str:
    return f"(SELECT {c} FROM dirty_customer WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query("pattern_signature", "\nUNION ALL\n".join(
    rf"""SELECT '{c}' AS name, regexp_replace(regexp_replace(regexp_replace({_top(c)}, '\s', ' ', 'g'), '[a-zA-Z]', 'A', 'g'), '\d', '9', 'g') AS pattern_signature"""
    for c in ("name", "email", "phone", "address", "website")
))
def pattern_signature(spark, sf):
    out = profile.column_profile(table(spark, sf, "dirty_customer"), ["name", "email", "phone", "address", "website"])
    return out.select("name", "pattern_signature")


def _numeric_profile_sql(table_name: str, columns: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS name, count(*) FILTER ({c} IS NULL) AS missing, count(DISTINCT {c}) AS "unique",
 count(*) - count(DISTINCT {c}) - CAST(count(*) FILTER ({c} IS NULL) > 0 AS BIGINT) AS duplicate_count,
 round_even(count(DISTINCT {c})::DOUBLE / count(*), 4) AS uniqueness_ratio,
 CAST(min({c}) AS DOUBLE) AS "min", CAST(max({c}) AS DOUBLE) AS "max", round_even(avg({c}), 4) AS mean,
 round_even(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS median, round_even(stddev_samp({c}), 4) AS std,
 (SELECT CAST({c} AS DOUBLE) FROM {table_name} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode,
 (SELECT count(*) FROM {table_name}, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM {table_name}) WHERE abs(({c} - m) / s) > 3) AS outlier_count_zscore FROM {table_name}"""
        for c in columns
    )


@query("column_profile_numeric", _numeric_profile_sql("null_orders", ["o_custkey", "o_totalprice"]))
def column_profile_numeric(spark, sf):
    out = profile.column_profile(table(spark, sf, "null_orders"), ["o_custkey", "o_totalprice"])
    return out.select("name", "missing", "unique", "duplicate_count", "uniqueness_ratio", "min", "max", "mean", "median", "std", "mode", "outlier_count_zscore")


def _text_profile_sql(columns: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS name, count(*) FILTER ({c} IS NULL) AS missing, count(DISTINCT {c}) AS "unique", {_top(c)} AS top,
 (SELECT count(*) FROM dirty_customer WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) AS top_count,
 round_even(100.0::DOUBLE * (SELECT count(*) FROM dirty_customer WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) / count(*), 2) AS top_pct,
 min(length({c})) AS min_length, max(length({c})) AS max_length, round_even(avg(length({c})), 2) AS mean_length,
 (SELECT round_even(-sum(p * log2(p)), 4) FROM (SELECT count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM dirty_customer WHERE {c} IS NOT NULL GROUP BY {c})) AS entropy FROM dirty_customer"""
        for c in columns
    )


@query("column_profile_text", _text_profile_sql(["name", "email", "country", "segment"]))
def column_profile_text(spark, sf):
    out = profile.column_profile(table(spark, sf, "dirty_customer"), ["name", "email", "country", "segment"])
    return out.select("name", "missing", "unique", "top", "top_count", "top_pct", "min_length", "max_length", "mean_length", "entropy")


_CUSTOMER_QUALITY = """WITH n AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT c_custkey) AS k, count(DISTINCT c_nationkey) AS nk FROM customer),
s AS (SELECT ((SELECT count(*) FROM customer WHERE c_custkey = 0) + (SELECT count(*) FROM customer WHERE c_nationkey = 0) + (SELECT count(*) FROM customer WHERE c_acctbal = 0)) / n / 5 AS sentinel, n, k, nk FROM n),
r AS (SELECT 100.0::DOUBLE AS completeness, round_even((1 - sentinel) * 100, 2) AS consistency, 0.0::DOUBLE AS validity, round_even((1 - sentinel / 2) * 100, 2) AS accuracy,
 100.0::DOUBLE AS uniqueness, round_even((k / n + nk / n) / 2 * 100, 2) AS integrity FROM s)
SELECT *, round_even((completeness + consistency + validity + accuracy + uniqueness + integrity) / 6, 2) AS overall FROM r"""


@query("quality_scores", _CUSTOMER_QUALITY)
def quality_scores(spark, sf):
    return profile.quality_scores(table(spark, sf, "customer"))


_ORDERS_QUALITY = """WITH o AS (SELECT row_id, o_orderstatus, o_totalprice FROM null_orders),
n AS (SELECT count(*)::DOUBLE AS n, count(o_orderstatus) AS ks, count(o_totalprice) AS kp, count(*) FILTER (row_id = 0) AS z, count(DISTINCT row_id) AS ids,
 count(*) FILTER (o_totalprice = 0) AS zp, count(*) FILTER (o_totalprice < 0) AS neg FROM o),
s AS (SELECT (z / n + zp / kp) / 3 AS sentinel, (2 * n - ks - kp) / (3 * n) AS missing, ids / n AS integrity, CASE WHEN neg = 0 THEN 0.5 ELSE 0 END AS validity FROM n),
r AS (SELECT round_even((1 - missing) * 100, 2) AS completeness, round_even((1 - sentinel) * 100, 2) AS consistency, round_even(validity * 100.0::DOUBLE, 2) AS validity,
 round_even((1 - (sentinel + missing) / 2) * 100, 2) AS accuracy, 100.0::DOUBLE AS uniqueness, round_even(integrity * 100, 2) AS integrity FROM s)
SELECT *, round_even((completeness + consistency + validity + accuracy + uniqueness + integrity) / 6, 2) AS overall FROM r"""


@query("quality_scores_orders", _ORDERS_QUALITY)
def quality_scores_orders(spark, sf):
    return profile.quality_scores(table(spark, sf, "null_orders").select("row_id", "o_orderstatus", "o_totalprice"))
