"""Ranked findings and each kind behind them."""

from __future__ import annotations

from catalog import query
from catalog.tables import table
from tablesmith.plans import insights

_KEPT = ["id", "severity", "title", "number", "pct"]
_ORDERS = "(SELECT o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM null_orders)"


def _orders(spark, sf):
    return table(spark, sf, "null_orders").drop("row_id")


_MISSING = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"))
_SHAPE = f"""SELECT 'shape' AS id, 'info' AS severity, 'Dataset shape' AS title, CAST(count(*) AS DOUBLE) AS number, CAST(NULL AS DOUBLE) AS pct FROM {_ORDERS}
UNION ALL SELECT 'duplicates', CASE WHEN p >= 5 THEN 'warning' ELSE 'info' END, 'Duplicate rows detected', d, p FROM (SELECT d, round_even(100.0::DOUBLE * d / n, 1) AS p FROM (SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {_ORDERS})) AS d FROM {_ORDERS})) WHERE d > 0
UNION ALL SELECT 'missing', CASE WHEN p >= 20 THEN 'error' WHEN p >= 5 THEN 'warning' ELSE 'info' END, 'Missing values', m, p FROM (SELECT m, round_even(100.0::DOUBLE * m / (5 * n), 2) AS p FROM (SELECT count(*) AS n, {_MISSING} AS m FROM {_ORDERS})) WHERE m > 0"""


@query("insight_missing", _SHAPE)
def insight_missing(spark, sf):
    return insights.shape_and_gaps(_orders(spark, sf)).select(*_KEPT)


def _hotspot(c):
    return f"""SELECT 'missing_{c}' AS id, CASE WHEN p < 40 THEN 'warning' ELSE 'error' END AS severity, 'High missing rate in ''{c}''' AS title, CAST(m AS DOUBLE) AS number, p AS pct
 FROM (SELECT count(*) FILTER ({c} IS NULL) AS m, round_even(100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*), 1) AS p FROM null_orders) WHERE p >= 10"""


_HOT = " UNION ALL ".join(_hotspot(c) for c in ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))


@query("insight_hotspots", _HOT)
def insight_hotspots(spark, sf):
    return insights.missing_hotspots(_orders(spark, sf)).select(*_KEPT)


@query("insight_corr", """SELECT 'corr_l_quantity_l_extendedprice' AS id, 'info' AS severity, 'Strong correlation: l_quantity ↔ l_extendedprice' AS title, round_even(r, 3) AS number, CAST(NULL AS DOUBLE) AS pct FROM (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem) WHERE abs(r) >= 0.7
UNION ALL SELECT 'corr_l_quantity_l_tax', 'info', 'Strong correlation: l_quantity ↔ l_tax', round_even(r, 3), NULL FROM (SELECT corr(l_quantity, l_tax) AS r FROM lineitem) WHERE abs(r) >= 0.7
UNION ALL SELECT 'corr_l_quantity_gross', 'info', 'Strong correlation: l_quantity ↔ gross', round_even(r, 3), NULL FROM (SELECT corr(l_quantity, l_quantity * (1 + l_tax)) AS r FROM lineitem) WHERE abs(r) >= 0.7
UNION ALL SELECT 'corr_l_extendedprice_gross', 'info', 'Strong correlation: l_extendedprice ↔ gross', round_even(r, 3), NULL FROM (SELECT corr(l_extendedprice, l_quantity * (1 + l_tax)) AS r FROM lineitem) WHERE abs(r) >= 0.7
UNION ALL SELECT 'corr_l_tax_gross', 'info', 'Strong correlation: l_tax ↔ gross', round_even(r, 3), NULL FROM (SELECT corr(l_tax, l_quantity * (1 + l_tax)) AS r FROM lineitem) WHERE abs(r) >= 0.7
UNION ALL SELECT 'corr_l_extendedprice_l_tax', 'info', 'Strong correlation: l_extendedprice ↔ l_tax', round_even(r, 3), NULL FROM (SELECT corr(l_extendedprice, l_tax) AS r FROM lineitem) WHERE abs(r) >= 0.7""")
def insight_corr(spark, sf):
    items = table(spark, sf, "lineitem").selectExpr("l_quantity", "l_extendedprice", "l_tax", "l_quantity * (1 + l_tax) AS gross")
    return insights.strong_correlations(items).select(*_KEPT)


def _skew(c, t):
    return f"SELECT 'skew_{c}' AS id, 'info' AS severity, 'Skewed distribution: ''{c}''' AS title, round_even(g, 3) AS number, CAST(NULL AS DOUBLE) AS pct FROM (SELECT skewness({c}) AS g, count({c}) AS n FROM {t}) WHERE n >= 5 AND abs(g) >= 1.5"


_SKEWED = " UNION ALL ".join(_skew(c, "null_orders") for c in ("o_custkey", "o_totalprice"))


@query("insight_skew", _SKEWED)
def insight_skew(spark, sf):
    return insights.skewed_columns(_orders(spark, sf)).select(*_KEPT)


_WIDE = range(20)


@query("insight_skew_wide", " UNION ALL ".join(f"SELECT 'skew_n{i:02}' AS id FROM null_orders WHERE o_totalprice IS NOT NULL GROUP BY 1 HAVING count(*) >= 5 AND abs(skewness(o_totalprice + {i})) >= 1.5" for i in _WIDE))
def insight_skew_wide(spark, sf):
    """Every column of a wide table is looked at."""
    view = table(spark, sf, "null_orders").selectExpr(*[f"o_totalprice + {i} AS n{i:02}" for i in _WIDE])
    return insights.skewed_columns(view).select("id")


def _cardinality(c, t):
    return f"""SELECT CASE WHEN u = 1 THEN 'const_{c}' WHEN u > greatest(50, floor(n * 0.5)) THEN 'highcard_{c}' ELSE 'top_{c}' END AS id, CASE WHEN u = 1 THEN 'warning' ELSE 'info' END AS severity,
 CASE WHEN u = 1 THEN 'Constant column ''{c}''' WHEN u > greatest(50, floor(n * 0.5)) THEN 'High cardinality: ''{c}''' ELSE 'Dominant category in ''{c}''' END AS title,
 CAST(CASE WHEN u = 1 OR u > greatest(50, floor(n * 0.5)) THEN u ELSE t END AS DOUBLE) AS number, CASE WHEN u BETWEEN 2 AND 12 AND u <= greatest(50, floor(n * 0.5)) THEN round_even(100.0::DOUBLE * t / n, 1) END AS pct
 FROM (SELECT count(DISTINCT {c}) AS u, count(*) AS n, (SELECT count(*) FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY 1 DESC LIMIT 1) AS t FROM {t}) WHERE u BETWEEN 1 AND 12 OR u > greatest(50, floor(n * 0.5))"""


@query("insight_cardinality", " UNION ALL ".join(_cardinality(c, "dirty_customer") for c in ("name", "gender", "country", "address", "segment", "score_text")))
def insight_cardinality(spark, sf):
    view = table(spark, sf, "dirty_customer").select("name", "gender", "country", "address", "segment", "score_text")
    return insights.category_findings(view).select(*_KEPT)


def _density(c, t):
    return f"""SELECT 'outlier_{c}' AS id, CASE WHEN p >= 5 THEN 'warning' ELSE 'info' END AS severity, 'Outliers in ''{c}''' AS title, CAST(o AS DOUBLE) AS number, p AS pct
 FROM (SELECT o, round_even(100.0::DOUBLE * o / n, 1) AS p FROM (SELECT count({c}) AS n, count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS o FROM {t}, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {t}) WHERE q3 > q1)) WHERE o > 0 AND p >= 2"""


@query("insight_outliers", _density("price_power", "(SELECT power(l_extendedprice / 1000, 6) AS price_power FROM lineitem)"))
def insight_outliers(spark, sf):
    items = table(spark, sf, "lineitem").selectExpr("power(l_extendedprice / 1000, 6) AS price_power")
    return insights.outlier_density(items).select(*_KEPT)


_RANKED = f"""SELECT id, severity, title, number, pct FROM ({_SHAPE} UNION ALL {_HOT} UNION ALL {_SKEWED} UNION ALL {_cardinality("o_orderstatus", "null_orders")} UNION ALL {_cardinality("o_orderpriority", "null_orders")}
UNION ALL {_density("o_custkey", "null_orders")} UNION ALL {_density("o_totalprice", "null_orders")}) ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, title LIMIT 12"""


@query("insights_ranked", _RANKED)
def insights_ranked(spark, sf):
    return insights.insights(_orders(spark, sf)).select(*_KEPT)
