"""Validation rules, quality, issue summary, report score."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.tables import table
from tablesmith.plans import report, validate

_EMAIL = r"'^[^@\s]+@[^@\s]+\.[^@\s]+$'"
_COLUMNS = ["name", "email", "age", "phone", "signup_date", "website", "score_text", "salary"]
_VIEW = "(SELECT name, email, age, phone, signup_date, website, score_text, salary FROM dirty_customer)"


def _view(spark, sf):
    return table(spark, sf, "dirty_customer").select(*_COLUMNS)


def _missing(c: str) -> str:
    return f"""SELECT 'missing_values' AS rule, '{c}' AS "column", CASE WHEN p < 30 THEN 'warning' ELSE 'error' END AS severity, n AS "count", p AS percentage FROM
 (SELECT count(*) FILTER ({c} IS NULL) AS n, round_even(100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*), 2) AS p FROM {_VIEW})"""


_BASIC = f"""SELECT * FROM ({" UNION ALL ".join(_missing(c) for c in _COLUMNS)}
UNION ALL SELECT 'whitespace', 'name', 'info', count(*) FILTER (name <> trim(name)), NULL FROM dirty_customer
UNION ALL SELECT 'invalid_email', 'email', 'error', count(*) FILTER (NOT regexp_matches(email, {_EMAIL})), NULL FROM dirty_customer
UNION ALL SELECT 'invalid_url', 'website', 'warning', count(*) FILTER (NOT regexp_matches(website, '^https?://[^\\s]+$')), NULL FROM dirty_customer
UNION ALL SELECT 'negative_values', 'age', 'warning', count(*) FILTER (age < 0), NULL FROM dirty_customer
UNION ALL SELECT 'outliers', 'age', 'info', count(*) FILTER (abs((age - m) / s) > 3), NULL FROM dirty_customer, (SELECT avg(age) AS m, stddev_pop(age) AS s FROM dirty_customer)
UNION ALL SELECT 'outliers', 'salary', 'info', count(*) FILTER (abs((salary - m) / s) > 3), NULL FROM dirty_customer, (SELECT avg(salary) AS m, stddev_pop(salary) AS s FROM dirty_customer)
UNION ALL SELECT 'duplicate_rows', NULL, 'warning', count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {_VIEW})), NULL FROM dirty_customer) WHERE "count" > 0"""


@query("validate_basic", _BASIC)
def validate_basic(spark, sf):
    return validate.validate(_view(spark, sf)).drop("message")


@query("validate_orders", """WITH f AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM null_orders)
SELECT * FROM (SELECT 'missing_values' AS rule, 'o_totalprice' AS "column", CASE WHEN 100.0 * count(*) FILTER (o_totalprice IS NULL) / count(*) < 30 THEN 'warning' ELSE 'error' END AS severity, count(*) FILTER (o_totalprice IS NULL) AS "count", concat(CAST(count(*) FILTER (o_totalprice IS NULL) AS VARCHAR), ' missing value(s) in ''o_totalprice''.') AS message FROM null_orders
UNION ALL SELECT 'outliers', 'o_totalprice', 'info', count(*) FILTER (abs((o_totalprice - m) / s) > 3), concat(CAST(count(*) FILTER (abs((o_totalprice - m) / s) > 3) AS VARCHAR), ' potential outlier(s) (z > 3) in ''o_totalprice''.') FROM null_orders, f) WHERE "count" > 0""")
def validate_orders(spark, sf):
    return validate.validate(table(spark, sf, "null_orders").select("row_id", "o_totalprice")).drop("percentage")


@query("validate_clean", """SELECT 'clean' AS rule, CAST(NULL AS VARCHAR) AS "column", 'success' AS severity WHERE (SELECT count(*) FILTER (c_custkey IS NULL OR c_name IS NULL OR c_name <> trim(c_name)) + count(*) - count(DISTINCT c_custkey) FROM customer) = 0""")
def validate_clean(spark, sf):
    found = validate.validate(table(spark, sf, "customer").select("c_custkey", "c_name"))
    return found.select("rule", "column", "severity")


_SENTINEL = "('', 'nan', 'na', 'n/a', 'none', 'null', 'nil', 'missing', 'unknown', 'undefined', '?', '-', '___', '(blank)', '[blank]')"
_PHONE = r"'^(\+?\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4}$'"
_LARGE_COLUMNS = ["name", "email", "age", "gender", "country", "phone", "signup_date", "website", "score_text", "salary"]
_LARGE_VIEW = f"(SELECT {', '.join(_LARGE_COLUMNS)} FROM dirty_customer)"


def _missing_large(c: str) -> str:
    lost = f"{c} IS NULL" if c in ("age", "salary") else f"({c} IS NULL OR lower(trim({c})) IN {_SENTINEL})"
    return f"""SELECT 'missing_values' AS rule, '{c}' AS "column", CASE WHEN p > 20 THEN 'error' WHEN p > 5 THEN 'warning' ELSE 'info' END AS severity, n AS "count", p AS percentage FROM
 (SELECT count(*) FILTER ({lost}) AS n, round_even(100.0::DOUBLE * count(*) FILTER ({lost}) / count(*), 2) AS p FROM dirty_customer) WHERE n > 0"""


def _mixed(c: str) -> str:
    return rf"""SELECT 'mixed_types', '{c}', 'info', NULL, NULL FROM (SELECT count(*) FILTER (regexp_matches(regexp_replace(regexp_replace({c}, '\.', ''), '-', ''), '^\d+$')) AS d, count({c}) AS n FROM dirty_customer) WHERE d > 0 AND d < n"""


def _casing(c: str) -> str:
    return f"""SELECT 'inconsistent_casing', '{c}', 'info', NULL, NULL FROM (SELECT count(DISTINCT {c}) AS u, count(DISTINCT lower({c})) AS l, count(*) AS n FROM dirty_customer) WHERE u <= n * 0.05 AND l < u"""


def _iqr(c: str) -> str:
    return f"""SELECT 'outliers_iqr', '{c}', 'warning', n, NULL FROM (SELECT count(*) FILTER (q3 > q1 AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))) AS n FROM dirty_customer, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM dirty_customer)) WHERE n > 0"""


_TEXTS = [c for c in _LARGE_COLUMNS if c not in ("age", "salary")]
_LARGE = f"""{" UNION ALL ".join(_missing_large(c) for c in _LARGE_COLUMNS)}
UNION ALL SELECT 'whitespace', 'name', 'info', n, NULL FROM (SELECT count(*) FILTER (name <> trim(name)) AS n FROM dirty_customer) WHERE n > 0
UNION ALL SELECT 'email_format', 'email', 'error', n, NULL FROM (SELECT count(*) FILTER (NOT regexp_matches(email, {_EMAIL})) AS n FROM dirty_customer) WHERE n > 0
UNION ALL SELECT 'phone_format', 'phone', 'warning', n, NULL FROM (SELECT count(*) FILTER (NOT regexp_matches(phone, {_PHONE})) AS n FROM dirty_customer) WHERE n > 0
UNION ALL SELECT 'date_format', 'signup_date', 'warning', n, NULL FROM (SELECT count(*) FILTER (signup_date IS NOT NULL AND try_strptime(signup_date, '%Y-%m-%d') IS NULL AND try_strptime(signup_date, '%m/%d/%Y') IS NULL) AS n FROM dirty_customer) WHERE n > 0
UNION ALL SELECT 'url_protocol', 'website', 'info', n, NULL FROM (SELECT count(*) FILTER (NOT regexp_matches(website, '^(https?|ftp)://')) AS n FROM dirty_customer) WHERE n > 0
UNION ALL {_iqr("age")} UNION ALL {_iqr("salary")}
UNION ALL {" UNION ALL ".join(_mixed(c) for c in _TEXTS)}
UNION ALL {" UNION ALL ".join(_casing(c) for c in _TEXTS)}
UNION ALL SELECT 'duplicate_rows', '*all*', CASE WHEN d > 0.05 * t THEN 'warning' ELSE 'info' END, d, NULL FROM (SELECT count(*) AS t, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {_LARGE_VIEW})) AS d FROM dirty_customer) WHERE d > 0"""


@query("validate_enterprise", _LARGE)
def validate_enterprise(spark, sf):
    return validate.validate_dataset(table(spark, sf, "dirty_customer").select(*_LARGE_COLUMNS)).drop("message")


@query("validate_copies", """SELECT 'duplicate_rows' AS rule, CASE WHEN d > 0.05 * t THEN 'warning' ELSE 'info' END AS severity, d AS "count" FROM (SELECT count(*) AS t, count(*) - count(DISTINCT (text, lang)) AS d FROM many_copies)
UNION ALL SELECT 'whitespace', 'info', count(*) FILTER (text <> regexp_replace(text, '^\\s+|\\s+$', '', 'g')) FROM many_copies HAVING count(*) FILTER (text <> regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 0""".replace("\\\\", "\\"))
def validate_copies(spark, sf):
    return validate.validate_dataset(table(spark, sf, "many_copies")).select("rule", "severity", "count")


_NULLS = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in _LARGE_COLUMNS)


@query("validate_quality", f"""WITH issues AS ({_LARGE}),
f AS (SELECT 1 - ({_NULLS}) / (count(*) * {len(_LARGE_COLUMNS)}::DOUBLE) AS complete FROM dirty_customer)
SELECT (SELECT count(*) FROM issues) AS total_issues, round_even(greatest((complete - least((SELECT count(*) FROM issues) * 2, 30) / 100.0::DOUBLE) * 100, 0), 2) AS overall_quality FROM f""")
def validate_quality(spark, sf):
    return validate.validation_quality(table(spark, sf, "dirty_customer").select(*_LARGE_COLUMNS))


@query("issue_summary", f"SELECT severity, count(*) AS n FROM ({_BASIC}) GROUP BY severity")
def issue_summary(spark, sf):
    return validate.issue_summary(validate.validate(_view(spark, sf)))


_VIEW_NULLS = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in _COLUMNS)


@query("report_quality", f"""WITH issues AS ({_BASIC}), f AS (SELECT count(*) AS n, round_even(100.0::DOUBLE * ({_VIEW_NULLS}) / (count(*) * {len(_COLUMNS)}), 2) AS missing_pct,
 count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {_VIEW})) AS dups FROM dirty_customer)
SELECT CAST(greatest(0, least(100, round_even(100 - least(missing_pct, 40) - least(100.0::DOUBLE * dups / n, 20)
 - (SELECT sum(CASE severity WHEN 'error' THEN 5 WHEN 'warning' THEN 2 WHEN 'info' THEN 0.5 ELSE 0 END) FROM issues)::DOUBLE, 0))) AS BIGINT) AS quality_score FROM f""")
def report_quality(spark, sf):
    return report.quality_score(_view(spark, sf))


@query("report_tables")
def report_tables(spark, sf):
    parts = report.build(table(spark, sf, "null_orders"))
    return _sizes(spark, parts)


@query("enterprise_report")
def enterprise_report(spark, sf):
    view = table(spark, sf, "dirty_pages")
    return _sizes(spark, report.enterprise(view, row_id="row_id", fuzzy_columns=["url"]))


def _sizes(spark, parts):
    out = None
    for name, df in parts.items():
        part = df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionAll(part)
    return out


@query("report_summary", """SELECT 'Rows' AS metric, CAST(count(*) AS VARCHAR) AS value FROM null_orders UNION ALL
SELECT 'Columns', '3' UNION ALL SELECT 'Total Cells', CAST(3 * count(*) AS VARCHAR) FROM null_orders UNION ALL
SELECT 'Missing Cells', CAST(count(*) FILTER (o_custkey IS NULL) + count(*) FILTER (o_totalprice IS NULL) AS VARCHAR) FROM null_orders UNION ALL
SELECT 'Duplicate Rows', CAST(count(*) - count(DISTINCT (row_id, o_custkey, o_totalprice)) AS VARCHAR) FROM null_orders""")
def report_summary(spark, sf):
    view = table(spark, sf, "null_orders").select("row_id", "o_custkey", "o_totalprice")
    out = report.summary_sheet(view)
    return out.where(F.col("metric").isin("Rows", "Columns", "Total Cells", "Missing Cells", "Duplicate Rows"))
