"""Findings about a table, ranked by severity.

Every finding is ``(id, severity, title, detail, column, number, pct)``. The kinds are planned
separately and joined by union; the measures behind them are one row per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.numbers import count_where, ratio
from tablesmith.operators import scale
from tablesmith.operators.analytics import correlation_pairs
from tablesmith.operators.stats import per_column
from tablesmith.operators.values import value_summary
from tablesmith.plans.profile import profile_summary
from tablesmith.types import categorical_columns, col, numeric_columns

COLUMNS = ("id", "severity", "title", "detail", "column", "number", "pct")
# Where a kind starts to speak.
_SKEW_ROWS, _SKEW = 5, 1.5
_OUTLIER_ROWS = 8
_STRONG, _STRONGEST = 0.7, 5


def _finding(id_: Column, severity: Column, title: Column, detail: Column, column: Column, number: Column, pct: Column):
    values = (id_, severity, title, detail, column, number.cast("double"), pct.cast("double"))
    kinds = ("string",) * 5 + ("double",) * 2
    return [v.cast(k).alias(n) for v, k, n in zip(values, kinds, COLUMNS)]


def _share(part: Column, whole: Column) -> Column:
    return F.bround(F.coalesce(ratio(part, F.greatest(whole, F.lit(1))), F.lit(0.0)) * 100, 1)


def _graded(pct: Column, warning: float, error: float | None = None) -> Column:
    grade = F.when(pct >= error, "error").when(pct >= warning, "warning") if error else F.when(pct >= warning, "warning")
    return grade.otherwise("info")


def shape_and_gaps(df: DataFrame) -> DataFrame:
    """Dataset shape, duplicate rows, missing cells."""
    numeric, categorical = len(numeric_columns(df)), len(categorical_columns(df))
    p = profile_summary(df)
    n, none = F.col, F.lit(None)
    dup_pct = _share(n("duplicate_rows"), n("rows"))
    shape = F.concat(
        n("rows").cast("string"), F.lit(" rows × "), n("columns").cast("string"),
        F.lit(f" columns ({numeric} numeric, {categorical} categorical)."),
    )
    copies = F.concat(n("duplicate_rows").cast("string"), F.lit(" duplicate rows ("), dup_pct.cast("string"), F.lit("%)."))
    gaps = F.concat(n("missing_cells").cast("string"), F.lit(" missing cells ("), n("missing_pct").cast("string"), F.lit("%)."))
    lit = F.lit
    rows = [
        _finding(lit("shape"), lit("info"), lit("Dataset shape"), shape, none, n("rows"), none),
        _finding(lit("duplicates"), _graded(dup_pct, 5), lit("Duplicate rows detected"), copies, none, n("duplicate_rows"), dup_pct),
        _finding(lit("missing"), _graded(n("missing_pct"), 5, 20), lit("Missing values"), gaps, none, n("missing_cells"), n("missing_pct")),
    ]
    found = p.select(F.inline(F.array(*[F.struct(*r) for r in rows])))
    return found.where("id = 'shape' OR number > 0")


def missing_hotspots(df: DataFrame) -> DataFrame:
    """Columns missing at least 10 % of their values."""
    cells = per_column(df, {c: {"rows": F.count(F.lit(1)), "missing": count_where(col(c).isNull())} for c in df.columns})
    pct = _share(F.col("missing"), F.col("rows"))
    return cells.where((F.col("missing") > 0) & (pct >= 10)).select(
        _finding(
            F.concat(F.lit("missing_"), F.col("column")),
            _graded(pct, 10, 40),
            F.concat(F.lit("High missing rate in '"), F.col("column"), F.lit("'")),
            F.concat(F.col("missing").cast("string"), F.lit(" missing values ("), pct.cast("string"), F.lit("%).")),
            F.col("column"),
            F.col("missing"),
            pct,
        )
    )


def strong_correlations(df: DataFrame) -> DataFrame:
    """The five strongest pairs with |r| of at least 0.7."""
    pairs = correlation_pairs(df).where(F.abs("r") >= _STRONG)
    strongest = pairs.orderBy(F.abs("r").desc(), "x", "y").limit(_STRONGEST)
    return strongest.select(
        _finding(
            F.concat_ws("_", F.lit("corr"), F.col("x"), F.col("y")),
            F.lit("info"),
            F.concat(F.lit("Strong correlation: "), F.col("x"), F.lit(" ↔ "), F.col("y")),
            F.concat(F.lit("Pearson r = "), F.bround("r", 3).cast("string"), F.lit(".")),
            F.concat_ws(",", "x", "y"),
            F.bround("r", 3),
            F.lit(None),
        )
    )


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness, as most statistics packages give it."""
    n = F.count(x).cast("double")
    spread = F.when(F.stddev_pop(x) > 0, F.skewness(x))
    return F.when(n > 2, spread * F.sqrt(n * (n - 1)) / (n - 2))


def skewed_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numeric columns (all unless named) with a skewness of at least 1.5 either way."""
    names = numeric_columns(df, columns)
    if not names:
        return _nothing(df)
    cells = per_column(df, {c: {"known": F.count(col(c)), "skew": sample_skewness(col(c).cast("double"))} for c in names})
    return cells.where((F.col("known") >= _SKEW_ROWS) & (F.abs("skew") >= _SKEW)).select(
        _finding(
            F.concat(F.lit("skew_"), F.col("column")),
            F.lit("info"),
            F.concat(F.lit("Skewed distribution: '"), F.col("column"), F.lit("'")),
            F.concat(F.lit("Skewness = "), F.bround("skew", 2).cast("string"), F.lit(".")),
            F.col("column"),
            F.bround("skew", 3),
            F.lit(None),
        )
    )


def category_findings(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Constant columns, columns with very many values, and the dominant value of small ones (all unless named)."""
    names = categorical_columns(df, columns)
    if not names:
        return _nothing(df)
    sizes = per_column(df, {c: {"rows": F.count(F.lit(1))} for c in names})
    cells = value_summary(df, names).join(F.broadcast(sizes), "column")
    unique, name = F.col("unique"), F.col("column")
    pct = _share(F.col("top_count"), F.col("rows"))
    many = unique > F.greatest(F.lit(50), F.floor(F.col("rows") * 0.5))
    quoted = F.concat(F.lit("'"), name, F.lit("'"))

    def pick(constant: Column, high: Column, top: Column) -> Column:
        return F.when(unique == 1, constant).when(many, high).when(unique.between(2, 12), top)

    found = cells.withColumn("kind", pick(F.lit("const"), F.lit("highcard"), F.lit("top"))).where("kind IS NOT NULL")
    return found.select(
        _finding(
            F.concat_ws("_", F.col("kind"), name),
            F.when(F.col("kind") == "const", "warning").otherwise("info"),
            pick(
                F.concat(F.lit("Constant column "), quoted),
                F.concat(F.lit("High cardinality: "), quoted),
                F.concat(F.lit("Dominant category in "), quoted),
            ),
            pick(
                F.lit("One value only."),
                F.concat(unique.cast("string"), F.lit(" different values.")),
                F.concat(F.lit("'"), F.col("top"), F.lit("' appears "), F.col("top_count").cast("string"), F.lit(" times ("), pct.cast("string"), F.lit("%).")),
            ),
            name,
            pick(unique, unique, F.col("top_count")),
            F.when(F.col("kind") == "top", pct),
        )
    )


def outlier_density(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numeric columns (all unless named) with at least 2 % of their values outside the IQR fences."""
    names = numeric_columns(df, columns)
    bounds = {c: b for c, b in scale.iqr_bounds(df, names).items() if b[2] > 0}
    if not bounds:
        return _nothing(df)
    cells = per_column(
        df,
        {c: {"known": F.count(col(c)), "out": count_where(scale.outside(c, lo, hi))} for c, (lo, hi, _) in bounds.items()},
    )
    pct = _share(F.col("out"), F.col("known"))
    spoken = (F.col("known") >= _OUTLIER_ROWS) & (F.col("out") > 0) & (pct >= 2)
    return cells.where(spoken).select(
        _finding(
            F.concat(F.lit("outlier_"), F.col("column")),
            _graded(pct, 5),
            F.concat(F.lit("Outliers in '"), F.col("column"), F.lit("'")),
            F.concat(F.col("out").cast("string"), F.lit(" values outside the IQR fences ("), pct.cast("string"), F.lit("%).")),
            F.col("column"),
            F.col("out"),
            pct,
        )
    )


def _nothing(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [], "id string, severity string, title string, detail string, column string, number double, pct double"
    )


def insights(df: DataFrame, max_insights: int = 12) -> DataFrame:
    """All findings, errors first, then warnings, then by title; at most ``max_insights`` (1..50)."""
    if not 1 <= max_insights <= 50:
        raise ValueError("max_insights is 1..50")
    found = shape_and_gaps(df)
    for kind in (missing_hotspots, strong_correlations, skewed_columns, category_findings, outlier_density):
        found = found.unionByName(kind(df))
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return found.orderBy(rank, "title").limit(max_insights)


