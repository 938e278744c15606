"""Reports: the tables a dataset report is made of. Rendering is left to the reader's tools."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.operators import analytics
from tablesmith.plans import outliers, profile, validate
from tablesmith.session import stored
from tablesmith.types import numeric_columns


def quality_score(df: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """One row ``(quality_score)`` 0..100: less missing share (at most 40), duplicate share (at most
    20), and 5, 2 or 0.5 points per error, warning or info."""
    found = validate.validate(df) if issues is None else issues
    points = (
        F.when(F.col("severity") == "error", 5.0)
        .when(F.col("severity") == "warning", 2.0)
        .when(F.col("severity") == "success", 0.0)
        .otherwise(0.5)
    )
    both = profile.profile_summary(df).unionByName(found.select(points.alias("points")), allowMissingColumns=True)
    share = F.col("duplicate_rows") * 100 / F.greatest("rows", F.lit(1))
    folded = both.agg(
        F.max("missing_pct").alias("missing_pct"),
        F.max(share).alias("dup_pct"),
        F.coalesce(F.sum("points"), F.lit(0.0)).alias("points"),
    )
    score = 100 - F.least("missing_pct", F.lit(40.0)) - F.least("dup_pct", F.lit(20.0)) - F.col("points")
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(score, 0)))
    return folded.select(clipped.cast("bigint").alias("quality_score"))


def build(df: DataFrame) -> dict[str, DataFrame]:
    """Profile, column statistics, issues with their summary, score, and the overview tables."""
    issues = validate.validate(df)
    out = {
        "summary": profile.profile_summary(df),
        "columns": profile.column_stats(df),
        "issues": issues,
        "issue_summary": validate.issue_summary(issues),
        "quality_score": quality_score(df, issues),
    }
    return out | {f"overview_{k}": v for k, v in analytics.overview(df).items()}


def _made(makers: dict[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], list[tuple[str, str, str]]]:
    """Run each section once and write it; one that fails, at any time, leaves a row instead."""
    out, errors = {}, []
    for name, make in makers.items():
        try:
            out[name] = stored(make(), f"report-{name}")
        except Exception as e:
            errors.append((name, type(e).__name__, str(e).splitlines()[0] if str(e) else ""))
    return out, errors


def enterprise(
    df: DataFrame,
    row_id: str,
    fuzzy_columns: Sequence[str] | None = None,
    fuzzy_threshold: float = 0.85,
    audit: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The sheets: Profile, Quality Scores, Validation, Outliers, Fuzzy Duplicates, Audit Log, Summary.

    Each section is computed once, and the summary reads what was written. A section that fails
    does not stop the others: it is missing, with its rows of the summary, and named in ``errors``.
    """
    from tablesmith.operators import fuzzy

    parts, errors = _made(
        {
            "profile": lambda: profile.column_profile(df),
            "quality_scores": lambda: profile.quality_scores(df),
            "validation": lambda: validate.validate_dataset(df),
            "outliers": lambda: outliers.outlier_report(df),
            "fuzzy_duplicates": lambda: fuzzy.fuzzy_groups(df, row_id, columns=fuzzy_columns, threshold=fuzzy_threshold),
        }
    )
    summary, failed = _made({"summary": lambda: _summary(profile.profile_totals(df), parts, audit)})
    out = dict(parts)
    if "quality_scores" in parts:
        out["quality_scores"] = _as_sheet(parts["quality_scores"])
    if audit is not None:
        out["audit_log"] = audit
    errors = df.sparkSession.createDataFrame(errors + failed, "section string, kind string, message string")
    return out | summary | {"errors": errors}


def score_sheet(df: DataFrame) -> DataFrame:
    """Quality scores as ``(metric, score)``."""
    return _as_sheet(profile.quality_scores(df))


def _as_sheet(scores: DataFrame) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("metric"), F.col(c).alias("score")) for c in scores.columns]
    return scores.select(F.inline(F.array(*cells)))


def summary_sheet(df: DataFrame, fuzzy: DataFrame | None = None, audit: DataFrame | None = None) -> DataFrame:
    """The ``(metric, value)`` summary; values are text, shares end in a percent sign."""
    parts = {"quality_scores": profile.quality_scores(df), "validation": validate.validate_dataset(df)}
    if numeric_columns(df):
        parts["outliers"] = outliers.outlier_report(df)
    if fuzzy is not None:
        parts["fuzzy_duplicates"] = fuzzy
    return _summary(profile.profile_totals(df), parts, audit)


# The labels of the summary.
_TOTALS = {
    "rows": "Rows", "columns": "Columns", "total_cells": "Total Cells", "missing_cells": "Missing Cells",
    "missing_pct": "Missing %", "duplicate_rows": "Duplicate Rows", "duplicate_pct": "Duplicate %",
}
_SCORES = {
    "overall": "Overall Quality Score", "completeness": "Completeness", "consistency": "Consistency",
    "validity": "Validity", "accuracy": "Accuracy", "uniqueness": "Uniqueness", "integrity": "Integrity",
}


def _summary(totals: DataFrame, parts: dict[str, DataFrame], audit: DataFrame | None) -> DataFrame:
    """The summary of the sections there are."""

    def sheet(one_row: DataFrame, labels: dict[str, str], suffix: dict[str, str] | None = None) -> DataFrame:
        cells = [
            F.struct(
                F.lit(label).alias("metric"),
                F.concat(F.col(c).cast("string"), F.lit((suffix or {}).get(c, ""))).alias("value"),
            )
            for c, label in labels.items()
        ]
        return one_row.select(F.inline(F.array(*cells)))

    count = F.count(F.lit(1))
    groups = F.count_distinct("group_id")
    out = sheet(totals, _TOTALS, {"missing_pct": "%", "duplicate_pct": "%"})
    if "quality_scores" in parts:
        out = out.unionAll(sheet(parts["quality_scores"], _SCORES))
    if "validation" in parts:
        out = out.unionAll(sheet(parts["validation"].agg(count.alias("n")), {"n": "Total Validation Issues"}))
    if "outliers" in parts:
        flagged = parts["outliers"].agg(F.coalesce(F.sum("total_unique"), F.lit(0)).alias("n"))
        out = out.unionAll(sheet(flagged, {"n": "Total Outliers"}))
    if "fuzzy_duplicates" in parts:
        found = parts["fuzzy_duplicates"].agg(groups.alias("g"), (count - groups).alias("d"))
        out = out.unionAll(sheet(found, {"g": "Fuzzy Duplicate Groups", "d": "Potential Duplicates"}))
    if audit is not None:
        out = out.unionAll(sheet(audit.agg(count.alias("n")), {"n": "Audit Log Entries"}))
    return out
