"""Column statistics, semantic types, quality scores: the dataset profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.functions import dates, numbers, patterns, text
from tablesmith.functions.numbers import count_where, percent, ratio
from tablesmith.operators.fill import medians
from tablesmith.operators.quantiles import exact_quantiles
from tablesmith.operators.stats import column_in, copies_summary, per_column, per_text
from tablesmith.operators.values import value_summary
from tablesmith.plans import sketches
from tablesmith.types import (
    col,
    column_types,
    datetime_columns,
    numeric_columns,
    select_columns,
    text_columns,
)


def _literal_map(values: dict, kind: str) -> Column:
    """A driver-side number per column, looked up by the ``column`` value."""
    known = {c: v for c, v in values.items() if v is not None}
    if not known:
        return F.lit(None).cast(kind)
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.try_element_at(table, F.col("column")).cast(kind)


def column_stats(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """One row per column: type, missing, unique; for numbers min, max, mean, std, median; else
    the most frequent value and its count.

    With ``approx`` one pass makes sketches of all columns: ``unique``, ``median``, ``top`` and its count
    are estimates within the bounds that ``sketches`` states, all else is exact.
    """
    if approx:
        return sketches.estimate(sketches.sketch_columns(df, columns))
    names, kinds = select_columns(df, columns), column_types(df)
    numeric = set(numeric_columns(df, names))

    def number(c: str) -> Column:
        return col(c).cast("double") if c in numeric else F.lit(None).cast("double")

    measures = {
        c: {
            "rows": F.count(F.lit(1)),
            "missing": count_where(col(c).isNull()),
            "min": F.min(number(c)),
            "max": F.max(number(c)),
            "mean": F.bround(F.avg(number(c)), 4),
            "std": F.bround(F.stddev_samp(number(c)), 4),
        }
        for c in names
    }
    middle = medians(df, sorted(numeric))
    values = value_summary(df, names)
    is_number = column_in(numeric)
    return (
        per_column(df, measures)
        .join(F.broadcast(values), "column", "left")
        .select(
            F.col("column").alias("name"),
            _literal_map(kinds, "string").alias("dtype"),
            "missing",
            percent(F.col("missing"), F.col("rows")).alias("missing_pct"),
            F.coalesce("unique", F.lit(0)).cast("bigint").alias("unique"),
            "min",
            "max",
            "mean",
            "std",
            _literal_map(middle, "double").alias("median"),
            F.when(~is_number, F.col("top")).alias("top"),
            F.when(~is_number, F.col("top_count")).alias("top_count"),
        )
    )


def profile_summary(df: DataFrame) -> DataFrame:
    """One row ``(rows, columns, duplicate_rows, missing_cells, missing_pct)``."""
    width = F.lit(len(df.columns)).cast("bigint")
    return copies_summary(df).select(
        "rows",
        width.alias("columns"),
        "duplicate_rows",
        "missing_cells",
        percent(F.col("missing_cells"), F.col("rows") * width).alias("missing_pct"),
    )


_RATIOS = {
    "email": patterns.EMAIL,
    "url": patterns.URL,
    "uuid": patterns.UUID,
    "percentage": patterns.PERCENTAGE,
    "currency": patterns.CURRENCY,
    "phone": patterns.PHONE,
    "ipv4": patterns.IPV4,
    "gender": patterns.GENDER,
    "boolean": patterns.BOOLEAN,
}


def semantic_types(df: DataFrame, columns: Sequence[str] | None = None, values: DataFrame | None = None) -> DataFrame:
    """``(column, semantic_type, confidence, date_parse_ratio)``: name and pattern rules, first match wins.

    All match counts come from one pass; the ordered rules run on the one-row-per-column result.
    ``values`` may hand in a value summary that is already planned.
    """
    names = select_columns(df, columns)
    texts = set(text_columns(df, names))
    value, low = F.col("value"), F.lower("value")

    def named(*words: str) -> Column:
        return column_in([c for c in names if any(w in c.lower() for w in words)])

    parsed_day = column_in(datetime_columns(df, names)) | dates.parse_date(value).isNotNull()
    measures = {"rows": F.count(F.lit(1)), "known": F.count(value)}
    measures |= {k: count_where(value.rlike(p)) for k, p in _RATIOS.items()}
    measures |= {
        "country": count_where(named("country", "nation") & low.isin(patterns.COUNTRY_NAMES)),
        "state": count_where(named("state", "province", "region") & low.isin(patterns.STATE_NAMES)),
        "numeric": count_where(numbers.looks_numeric(value)),
        "dates": count_where(value.isNotNull() & parsed_day),
    }
    if values is None:
        values = value_summary(df, names)
    counted = per_text(df, names, measures).join(F.broadcast(values.select("column", "unique")), "column", "left")
    counted = counted.fillna(0)
    name = F.lower("column")

    def has(*words: str) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(name, F.lit(w))
        return hit

    def share(k: str) -> Column:
        return F.coalesce(ratio(F.col(k), F.col("known")), F.lit(0.0))

    def found(kind: str, confidence: Column | float) -> Column:
        c = confidence if isinstance(confidence, Column) else F.lit(confidence)
        return F.struct(F.lit(kind).alias("type"), c.cast("double").alias("confidence"))

    def by_name_or(kind: str, words: tuple[str, ...], named: float, least: float):
        rule = has(*words) | (share(kind) >= least)
        return rule, found(kind, F.when(has(*words), F.lit(named)).otherwise(share(kind)))

    rules = [
        (F.col("known") == 0, found("empty", 1.0)),
        by_name_or("email", ("email",), 0.95, 0.8),
        by_name_or("url", ("url", "website"), 0.95, 0.8),
        (share("uuid") >= 0.9, found("uuid", share("uuid"))),
        (share("percentage") >= 0.8, found("percentage", share("percentage"))),
        (share("currency") >= 0.8, found("currency", share("currency"))),
        by_name_or("phone", ("phone", "mobile", "contact"), 0.9, 0.8),
        (has("zip", "postal", "pincode"), found("zip", 0.85)),
        (share("ipv4") >= 0.9, found("ipv4", share("ipv4"))),
        by_name_or("gender", ("gender", "sex"), 0.95, 0.8),
        (has("country", "nation") & (share("country") >= 0.7), found("country", share("country"))),
        (has("state", "province", "region") & (share("state") >= 0.5), found("state", share("state"))),
        (has("name", "first", "last", "full_name"), found("name", 0.75)),
        (has("address", "street", "city"), found("address", 0.75)),
        (has("date", "time", "dob", "birth"), found("date", 0.75)),
        (
            (name == "id") | name.endswith("_id") | name.startswith("id_") | has("identifier") | name.endswith("_key"),
            found("id", 0.9),
        ),
        (share("boolean") >= 0.8, found("boolean", share("boolean"))),
        (share("numeric") >= 0.9, found("numeric", share("numeric"))),
        (F.coalesce("unique", F.lit(0)) <= F.col("rows") * 0.05, found("categorical", 0.8)),
    ]
    chain = F.when(*rules[0])
    for rule, result in rules[1:]:
        chain = chain.when(rule, result)
    picked = chain.otherwise(found("text", 0.6))
    is_text = column_in(texts)
    parsed = share("dates")
    ruled = counted.withColumn("picked", picked)
    checked = (F.col("picked.type") == "date") | is_text
    overridden = is_text & (parsed >= 0.7) & (F.col("picked.type") != "date")
    return ruled.select(
        "column",
        F.when(overridden, F.lit("date")).otherwise(F.col("picked.type")).alias("semantic_type"),
        F.bround(F.when(overridden, parsed).otherwise(F.col("picked.confidence")), 4).alias("confidence"),
        F.when(checked, F.bround(parsed, 4)).alias("date_parse_ratio"),
    )


def sentinel_ratios(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, known, sentinels, ratio)``: share of known values that stand for missing."""
    names = select_columns(df, columns)
    measures = {"known": F.count("value"), "sentinels": count_where(_is_sentinel(df))}
    out = per_text(df, names, measures).fillna(0)
    return out.withColumn("ratio", F.coalesce(ratio(F.col("sentinels"), F.col("known")), F.lit(0.0)))


def _is_sentinel(df: DataFrame) -> Column:
    """Over unpivoted cells. Numbers hold no blanks, so only texts are stripped first."""
    value = F.col("value")
    plain = value.isin(text.PROFILER_SENTINELS)
    return F.when(column_in(text_columns(df)), text.is_sentinel(value, text.PROFILER_SENTINELS)).otherwise(plain)


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The full profile, one row per column.

    Number statistics cover numeric columns and the numeric values of text columns; length and
    pattern statistics cover texts and columns of a categorical meaning.
    """
    names, kinds = select_columns(df, columns), column_types(df)
    numeric, texts = set(numeric_columns(df, names)), set(text_columns(df, names))

    def number(c: str) -> Column:
        if c in numeric:
            return col(c).cast("double")
        return numbers.to_number(col(c)) if c in texts else F.lit(None).cast("double")

    with_numbers = [c for c in names if c in numeric or c in texts]
    values = df.select(*[number(c).alias(c) for c in with_numbers]) if with_numbers else None
    spread = {}
    if values is not None:
        row = values.agg(
            *[F.struct(F.avg(col(c)), F.stddev_pop(col(c)), F.count(col(c))).alias(c) for c in with_numbers]
        ).first()
        spread = {c: row[c] for c in with_numbers if row[c][2]}
    middle = {c: v[0] for c, v in exact_quantiles(df, {c: number(c) for c in spread}, [0.5]).items()}

    def z_outliers(c: str) -> Column:
        mean, std = (spread[c][0], spread[c][1]) if c in spread else (None, None)
        if not std:
            return count_where(F.lit(False))
        return count_where(F.abs((number(c) - F.lit(mean)) / F.lit(std)) > 3)

    measures = {
        c: {
            "rows": F.count(F.lit(1)),
            "missing": count_where(col(c).isNull()),
            "min": F.min(number(c)),
            "max": F.max(number(c)),
            "mean": F.bround(F.avg(number(c)), 4),
            "variance": F.bround(F.var_pop(number(c)), 4),
            "std": F.bround(F.stddev_samp(number(c)), 4),
            "outlier_count_zscore": z_outliers(c),
        }
        for c in names
    }
    length = F.length("value")
    as_text = {
        "sentinels": count_where(_is_sentinel(df)),
        "min_length": F.min(length).cast("bigint"),
        "max_length": F.max(length).cast("bigint"),
        "mean_length": F.bround(F.avg(length), 2),
    }
    values_seen = value_summary(df, names)
    out = per_column(df, measures).join(F.broadcast(per_text(df, names, as_text)), "column", "left")
    out = out.join(F.broadcast(values_seen), "column", "left")
    if spread:
        number_modes = value_summary(values.select(*[col(c) for c in spread]), list(spread))
        number_modes = number_modes.select("column", F.col("top").cast("double").alias("mode"))
    else:
        number_modes = out.select("column", F.lit(None).cast("double").alias("mode"))
    out = out.join(F.broadcast(number_modes), "column", "left")
    out = out.join(F.broadcast(semantic_types(df, names, values_seen)), "column", "left")
    known = F.col("rows") - F.col("missing")
    unique = F.coalesce("unique", F.lit(0))
    is_text = column_in(texts)
    wordy = is_text | F.col("semantic_type").isin("categorical", "gender", "country", "state")
    numbers_seen = column_in(spread)
    return out.select(
        F.col("column").alias("name"),
        _literal_map(kinds, "string").alias("dtype"),
        "missing",
        percent(F.col("missing"), F.col("rows")).alias("missing_pct"),
        unique.cast("bigint").alias("unique"),
        (F.col("rows") - unique - (F.col("missing") > 0).cast("bigint")).alias("duplicate_count"),
        F.bround(F.coalesce(ratio(unique, F.col("rows")), F.lit(0.0)), 4).alias("uniqueness_ratio"),
        F.bround("entropy", 4).alias("entropy"),
        percent(F.col("sentinels"), known).alias("sentinel_missing_pct"),
        "semantic_type",
        F.col("confidence").alias("semantic_confidence"),
        "date_parse_ratio",
        "min",
        "max",
        "mean",
        F.bround(_literal_map(middle, "double"), 4).alias("median"),
        "mode",
        "variance",
        "std",
        F.when(numbers_seen, F.col("outlier_count_zscore")).alias("outlier_count_zscore"),
        F.when(wordy, F.col("top")).alias("top"),
        F.when(wordy, F.col("top_count")).alias("top_count"),
        F.when(wordy, percent(F.col("top_count"), F.col("rows"))).alias("top_pct"),
        F.when(wordy, text.pattern_signature(F.col("top"))).alias("pattern_signature"),
        *[F.when(wordy, F.col(k)).alias(k) for k in ("min_length", "max_length", "mean_length")],
    )


def quality_scores(df: DataFrame) -> DataFrame:
    """One row of six scores (0..100) and their mean.

    Validity counts one check per numeric column and passes only columns whose name holds a
    never-negative word and that hold no negative value; a numeric column with another name
    never passes. That is the published scoring rule and is kept.
    """
    names = list(df.columns)
    numeric, texts = set(numeric_columns(df)), set(text_columns(df))
    identity = [c for c in names if any(w in c.lower() for w in patterns.INTEGRITY_WORDS)]

    emails = [c for c in texts if "email" in c.lower()]
    guarded = [c for c in numeric if any(w in c.lower() for w in patterns.VALIDITY_WORDS)]
    value = F.col("value")
    bad = F.when(column_in(emails), ~value.rlike(patterns.EMAIL)).when(column_in(guarded), value.startswith("-"))
    zero = F.when(column_in(numeric), value.rlike("^-0(\\.0+)?$"))
    cells = per_text(
        df,
        names,
        {
            "rows": F.count(F.lit(1)),
            "known": F.count(value),
            "sentinels": count_where(_is_sentinel(df)),
            "bad": count_where(bad & ~F.coalesce(zero, F.lit(False))),
        },
    ).fillna(0)
    cells = cells.select(
        "*",
        (column_in(numeric) | (column_in(emails) & (F.col("known") > 0))).alias("checked"),
        (column_in(emails) | column_in(guarded)).alias("can_pass"),
    )
    if identity:
        cells = cells.join(
            F.broadcast(value_summary(df.select(*[col(c) for c in identity]), identity).select("column", "unique")),
            "column",
            "left",
        )
    else:
        cells = cells.withColumn("unique", F.lit(None).cast("bigint"))
    both = cells.unionByName(copies_summary(df).select("duplicate_rows"), allowMissingColumns=True)
    one = lambda c: F.coalesce(c, F.lit(0))
    folded = both.agg(
        F.max("rows").alias("rows"),
        one(F.sum(F.col("rows") - F.col("known"))).alias("missing"),
        one(F.sum("rows")).alias("cells"),
        F.avg(F.when(F.col("column").isNotNull(), F.coalesce(ratio(F.col("sentinels"), F.col("known")), F.lit(0.0)))).alias("sentinel"),
        F.count_if(F.coalesce("checked", F.lit(False))).alias("checks"),
        F.count_if(F.coalesce(F.col("checked") & F.col("can_pass") & (F.col("bad") == 0), F.lit(False))).alias("passed"),
        F.avg(ratio(F.col("unique"), F.col("known"))).alias("integrity"),
        one(F.max("duplicate_rows")).alias("duplicates"),
    )
    missing = F.coalesce(ratio(F.col("missing"), F.col("cells")), F.lit(0.0))
    sentinel = F.coalesce("sentinel", F.lit(0.0))
    scores = {
        "completeness": 1 - missing,
        "consistency": F.greatest(1 - sentinel, F.lit(0.0)),
        "validity": F.coalesce(ratio(F.col("passed"), F.col("checks")), F.lit(1.0)),
        "accuracy": F.greatest(1 - (sentinel + missing) / 2, F.lit(0.0)),
        "uniqueness": 1 - F.coalesce(ratio(F.col("duplicates"), F.col("rows")), F.lit(0.0)),
        "integrity": F.coalesce("integrity", F.lit(1.0)),
    }
    scored = folded.select(*[F.bround(s * 100, 2).alias(k) for k, s in scores.items()])
    total = sum((F.col(k) for k in scores), F.lit(0.0))
    return scored.withColumn("overall", F.bround(total / len(scores), 2))


def profile_totals(df: DataFrame) -> DataFrame:
    """One row of dataset totals."""
    out = profile_summary(df)
    return out.select(
        "rows",
        "columns",
        (F.col("rows") * F.col("columns")).alias("total_cells"),
        "missing_cells",
        "missing_pct",
        "duplicate_rows",
        percent(F.col("duplicate_rows"), F.col("rows")).alias("duplicate_pct"),
    )


def profile_dataset(df: DataFrame) -> dict[str, DataFrame]:
    """Totals, scores, column profiles and the unrounded correlation matrix."""
    from tablesmith.operators.analytics import correlation

    out = {"totals": profile_totals(df), "quality_scores": quality_scores(df), "columns": column_profile(df)}
    if len(numeric_columns(df)) >= 2:
        out["correlation"] = correlation(df, digits=None)
    return out
