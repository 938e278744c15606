"""Rule-based validation: every rule of every column counted in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.functions import dates, patterns, text
from tablesmith.functions.numbers import count_where, percent, ratio
from tablesmith.operators import scale
from tablesmith.operators.stats import column_in, copies_summary, per_column, per_text
from tablesmith.operators.values import value_table
from tablesmith.types import col, numeric_columns, text_columns

ISSUE_COLUMNS = ("rule", "column", "severity", "message", "count", "percentage")


def _named(c: str, words: Sequence[str]) -> bool:
    return any(w in c.lower() for w in words)


def _among(columns: Sequence[str], words: Sequence[str]) -> Column:
    return column_in([c for c in columns if _named(c, words)])


def _with_text_rules(df: DataFrame, cells: DataFrame, columns: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """Join the counts of rules that read cells as text; columns not read count 0."""
    if not columns:
        return cells.withColumns({k: F.lit(0).cast("bigint") for k in rules})
    counted = cells.join(F.broadcast(per_text(df, columns, rules)), "column", "left")
    return counted.withColumns({k: F.coalesce(k, F.lit(0)) for k in rules})


def _unpivot(cells: DataFrame, rules: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """Turn rule counts into issue rows; a rule is (count, severity, message)."""
    none = F.lit(None)
    issues = [
        F.struct(
            F.lit(rule).alias("rule"),
            F.col("column"),
            severity.alias("severity"),
            message.alias("message"),
            count.cast("bigint").alias("count"),
            (F.col("missing_pct") if rule == "missing_values" else none).cast("double").alias("percentage"),
        )
        for rule, (count, severity, message) in rules.items()
    ]
    return cells.select(F.inline(F.array(*issues))).where("count > 0")


def _said(count: Column, what: str) -> Column:
    return F.concat(count.cast("string"), F.lit(f" {what} in '"), F.col("column"), F.lit("'."))


def validate(df: DataFrame) -> DataFrame:
    """Basic rules: duplicates, missing, white space, email, url, negatives, z-score outliers.

    A table without findings gives one row of rule ``clean``.
    """
    numeric = numeric_columns(df)
    moments = scale.moments(df, numeric)
    never = F.lit(False)

    def measures(c: str) -> dict[str, Column]:
        mean, std = moments.get(c, (None, None))
        v = col(c)
        watched = c in moments and _named(c, patterns.NEGATIVE_WORDS)
        return {
            "rows": F.count(F.lit(1)),
            "missing": count_where(v.isNull()),
            "negative": count_where(v < 0 if watched else never),
            "outlying": count_where(F.abs(scale.z_score(c, mean, std)) > scale.Z_LIMIT if std else never),
        }

    texts = text_columns(df)
    value = F.col("value")
    text_rules = {
        "spaced": count_where(text.has_edge_space(value)),
        "bad_email": count_where(_among(texts, ("email",)) & ~value.rlike(patterns.EMAIL)),
        "bad_url": count_where(_among(texts, ("url", "website")) & ~value.rlike(patterns.URL)),
    }
    cells = _with_text_rules(df, per_column(df, {c: measures(c) for c in df.columns}), texts, text_rules)
    cells = cells.withColumn("missing_pct", percent(F.col("missing"), F.col("rows")))
    warning, info, error = F.lit("warning"), F.lit("info"), F.lit("error")
    by_share = F.when(F.col("missing_pct") < 30, warning).otherwise(error)
    n = F.col
    issues = _unpivot(
        cells,
        {
            "missing_values": (n("missing"), by_share, _said(n("missing"), "missing value(s)")),
            "whitespace": (n("spaced"), info, _said(n("spaced"), "value(s) with outer blanks")),
            "invalid_email": (n("bad_email"), error, _said(n("bad_email"), "invalid email(s)")),
            "invalid_url": (n("bad_url"), warning, _said(n("bad_url"), "invalid URL(s)")),
            "negative_values": (n("negative"), warning, _said(n("negative"), "negative value(s)")),
            "outliers": (n("outlying"), info, _said(n("outlying"), "potential outlier(s) (z > 3)")),
        },
    )
    copies = copies_summary(df).where("duplicate_rows > 0")
    duplicates = copies.select(
        F.lit("duplicate_rows").alias("rule"),
        F.lit(None).cast("string").alias("column"),
        warning.alias("severity"),
        F.concat(n("duplicate_rows").cast("string"), F.lit(" duplicate row(s).")).alias("message"),
        n("duplicate_rows").alias("count"),
        F.lit(None).cast("double").alias("percentage"),
    )
    found = issues.unionByName(duplicates)
    clean = F.struct(
        F.lit("clean").alias("rule"),
        F.lit(None).cast("string").alias("column"),
        F.lit("success").alias("severity"),
        F.lit("No data quality issue found.").alias("message"),
        F.lit(0).cast("bigint").alias("count"),
        F.lit(None).cast("double").alias("percentage"),
    )
    # at most columns x rules entries, so one list holds them
    listed = found.agg(F.collect_list(F.struct(*ISSUE_COLUMNS)).alias("issues"))
    return listed.select(F.inline(F.when(F.size("issues") == 0, F.array(clean)).otherwise(F.col("issues"))))


def _digits_with_signs(v: Column) -> Column:
    """Digits with at most one dot and one minus sign, anywhere."""
    dots = F.length(v) - F.length(F.replace(v, F.lit("."), F.lit("")))
    signs = F.length(v) - F.length(F.replace(v, F.lit("-"), F.lit("")))
    return v.rlike(r"^[0-9.\-]*[0-9][0-9.\-]*$") & (dots <= 1) & (signs <= 1)


def _casing(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, unique, folded)``: distinct values, and distinct values ignoring case."""
    forms = value_table(df, columns).groupBy("column", F.lower("value").alias("low")).agg(F.count(F.lit(1)).alias("f"))
    return forms.groupBy("column").agg(F.sum("f").alias("unique"), F.count(F.lit(1)).alias("folded"))


def validate_dataset(df: DataFrame) -> DataFrame:
    """The larger rule set: missing (with sentinels), white space, email, phone, date, url, IQR
    outliers, mixed types, inconsistent casing, duplicate rows."""
    texts = text_columns(df)
    bounds = scale.iqr_bounds(df, numeric_columns(df))
    never = F.lit(False)

    def measures(c: str) -> dict[str, Column]:
        low, high, iqr = bounds.get(c, (None, None, None))
        return {
            "rows": F.count(F.lit(1)),
            "nulls": count_where(col(c).isNull()),
            "outlying": count_where(scale.outside(c, low, high) if iqr and iqr > 0 else never),
        }

    value = F.col("value")
    with_protocol = value.startswith("http://") | value.startswith("https://") | value.startswith("ftp://")
    day_named = _among(texts, patterns.DATE_WORDS)
    text_rules = {
        "sentinels": count_where(column_in(texts) & text.is_sentinel(value)),
        "spaced": count_where(column_in(texts) & text.has_edge_space(value)),
        "bad_email": count_where(_among(df.columns, patterns.EMAIL_WORDS) & ~value.rlike(patterns.EMAIL)),
        "bad_phone": count_where(_among(df.columns, patterns.PHONE_WORDS) & ~value.rlike(patterns.PHONE)),
        "bad_date": count_where(day_named & value.isNotNull() & dates.parse_date(value).isNull()),
        "no_protocol": count_where(_among(df.columns, patterns.URL_WORDS) & ~with_protocol),
        "digits": count_where(column_in(texts) & _digits_with_signs(value)),
        "texts": F.count_if(column_in(texts) & value.isNotNull()),
    }
    read_as_text = [
        c
        for c in df.columns
        if c in texts or _named(c, patterns.EMAIL_WORDS + patterns.PHONE_WORDS + patterns.URL_WORDS)
    ]
    cells = _with_text_rules(df, per_column(df, {c: measures(c) for c in df.columns}), read_as_text, text_rules)
    cells = cells.withColumn("missing", F.col("nulls") + F.col("sentinels"))
    cells = cells.withColumn("mixed", (F.col("digits") > 0) & (F.col("digits") < F.col("texts")))
    cells = cells.withColumn("missing_pct", percent(F.col("missing"), F.col("rows")))
    if texts:
        cells = cells.join(F.broadcast(_casing(df, texts)), "column", "left")
    else:
        cells = cells.withColumns({k: F.lit(None).cast("bigint") for k in ("unique", "folded")})
    n, error, warning, info = F.col, F.lit("error"), F.lit("warning"), F.lit("info")
    by_share = F.when(n("missing_pct") > 20, error).when(n("missing_pct") > 5, warning).otherwise(info)
    uneven = (F.coalesce("unique", F.lit(0)) <= n("rows") * 0.05) & (n("folded") < n("unique"))
    mixed_note = F.concat(F.lit("Column '"), n("column"), F.lit("' mixes numbers and text."))
    case_note = F.concat(
        F.lit("Column '"), n("column"), F.lit("' mixes case: "), n("unique").cast("string"), F.lit(" values, "),
        n("folded").cast("string"), F.lit(" ignoring case."),
    )
    issues = _unpivot(
        cells,
        {
            "missing_values": (n("missing"), by_share, _said(n("missing"), "missing value(s)")),
            "whitespace": (n("spaced"), info, _said(n("spaced"), "value(s) with outer blanks")),
            "email_format": (n("bad_email"), error, _said(n("bad_email"), "invalid email(s)")),
            "phone_format": (n("bad_phone"), warning, _said(n("bad_phone"), "invalid phone number(s)")),
            "date_format": (n("bad_date"), warning, _said(n("bad_date"), "unreadable date(s)")),
            "url_protocol": (n("no_protocol"), info, _said(n("no_protocol"), "URL(s) without a protocol")),
            "outliers_iqr": (n("outlying"), warning, _said(n("outlying"), "potential outlier(s) (IQR)")),
            "mixed_types": (n("mixed").cast("bigint"), info, mixed_note),
            "inconsistent_casing": (F.coalesce(uneven, never).cast("bigint"), info, case_note),
        },
    )
    uncounted = n("rule").isin("mixed_types", "inconsistent_casing")
    issues = issues.withColumn("count", F.when(~uncounted, n("count")))
    share = ratio(n("duplicate_rows"), n("rows"))
    duplicates = (
        copies_summary(df)
        .where("duplicate_rows > 0")
        .select(
            F.lit("duplicate_rows").alias("rule"),
            F.lit("*all*").alias("column"),
            F.when(share > 0.05, warning).otherwise(info).alias("severity"),
            F.concat(n("duplicate_rows").cast("string"), F.lit(" duplicate row(s).")).alias("message"),
            n("duplicate_rows").alias("count"),
            F.lit(None).cast("double").alias("percentage"),
        )
    )
    return issues.unionByName(duplicates)


def validation_quality(df: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """One row ``(total_issues, overall_quality)``: completeness less two points per issue, at most 30."""
    found = validate_dataset(df) if issues is None else issues
    known = per_column(df, {c: {"rows": F.count(F.lit(1)), "known": F.count(col(c))} for c in df.columns})
    both = known.unionByName(found.select("rule"), allowMissingColumns=True)
    complete = F.coalesce(ratio(F.sum("known"), F.sum("rows")), F.lit(1.0))
    penalty = F.least(F.count("rule") * 2, F.lit(30)) / F.lit(100.0)
    return both.agg(
        F.count("rule").alias("total_issues"),
        F.bround(F.greatest((complete - penalty) * 100, F.lit(0.0)), 2).alias("overall_quality"),
    )


def issue_summary(issues: DataFrame) -> DataFrame:
    """``(severity, n)``: issues per severity."""
    return issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
