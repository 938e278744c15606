"""Audited cleaning: the single steps, and the fourteen-step pipeline made of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.functions import numbers, patterns, repair, text
from tablesmith.functions.numbers import count_where
from tablesmith.operators import fill, rows, scale
from tablesmith.operators.ordering import add_row_id, fill_along, is_generated
from tablesmith.operators.quantiles import exact_quantiles, median_absolute_deviation
from tablesmith.operators.values import mode_literal, modes
from tablesmith.plans.audit import LOG, Audited, cells_changed, entry
from tablesmith.session import first_row, spread, stored
from tablesmith.types import BOOLEAN, DATETIME, STRING, col, column_types, named_like, numeric_columns, text_columns

MAX_DELETION_PCT = 5.0
_CONVERT_SHARE = 0.9


def _texts(t: Audited, columns: Sequence[str] | None, words: Sequence[str] | None = None) -> list[str]:
    """Text columns a step acts on: the named ones, else those its name rule selects."""
    texts = [c for c in text_columns(t.frame) if c in t.columns]
    if columns is not None:
        return [c for c in texts if c in columns]
    if words is None:
        return texts
    hits = named_like(t.frame, words)
    return [c for c in texts if c in hits]


def normalize_sentinels(t: Audited, columns: Sequence[str] | None = None) -> Audited:
    return t.step({c: repair.sentinel for c in _texts(t, columns)})


def clean_text(t: Audited, columns: Sequence[str] | None = None) -> Audited:
    return t.step({c: repair.tidy_text for c in _texts(t, columns)}, prepare=text.tidy)


def standardize_names(t: Audited, columns: Sequence[str] | None = None) -> Audited:
    return t.step({c: repair.name_case for c in _texts(t, columns, patterns.NAME_WORDS)})


def standardize_categories(t: Audited, columns: Sequence[str] | None = None) -> Audited:
    gender = repair.category(patterns.GENDERS, "gender")
    country = repair.category(patterns.COUNTRIES, "country")
    repairs: dict[str, Callable[[Column], Column]] = {}
    for c in _texts(t, columns):
        if any(w in c.lower() for w in patterns.GENDER_WORDS):
            repairs[c] = gender
        elif any(w in c.lower() for w in patterns.COUNTRY_WORDS):
            repairs[c] = country
    return t.step(repairs)


def repair_emails(t: Audited, columns: Sequence[str] | None = None) -> Audited:
    return t.step({c: repair.email for c in _texts(t, columns, patterns.EMAIL_WORDS)})


def standardize_dates(t: Audited, columns: Sequence[str] | None = None) -> Audited:
    """Texts become ``yyyy-MM-dd``; date and time columns lose their time of day."""
    repairs = {c: repair.date_text for c in _texts(t, columns, patterns.DATE_WORDS)}
    kinds = column_types(t.frame)
    chosen = columns if columns is not None else named_like(t.frame, patterns.DATE_WORDS)
    repairs |= {c: repair.date_value for c in t.columns if kinds[c] == DATETIME and c in chosen}
    return t.step(repairs)


def standardize_phones(t: Audited, columns: Sequence[str] | None = None) -> Audited:
    return t.step({c: repair.phone for c in _texts(t, columns, patterns.PHONE_WORDS)})


def standardize_addresses(t: Audited, columns: Sequence[str] | None = None) -> Audited:
    return t.step({c: repair.address for c in _texts(t, columns, patterns.ADDRESS_WORDS)})


def standardize_urls(t: Audited, columns: Sequence[str] | None = None) -> Audited:
    return t.step({c: repair.url for c in _texts(t, columns, patterns.URL_WORDS)})


def convert_data_types(
    t: Audited, columns: Sequence[str] | None = None, strip_symbols_first: bool = False
) -> Audited:
    """Text columns of which at least 90 % are numbers become double.

    The share is counted on the raw texts, so ``$1,200`` counts as text unless
    ``strip_symbols_first`` is set.
    """
    texts = _texts(t, columns)
    if not texts:
        return t

    def reads(c: str) -> Column:
        return numbers.convert_value(col(c), "float").isNotNull() if strip_symbols_first else numbers.looks_numeric(col(c))

    shares = first_row(
        t.data.agg(*[F.struct(count_where(reads(c)), F.count(col(c))).alias(c) for c in texts])
    )
    numeric = [c for c in texts if shares[c][1] and shares[c][0] / shares[c][1] >= _CONVERT_SHARE]

    def convert(v: Column) -> Column:
        new = numbers.convert_value(v, "float")
        note = F.concat(F.lit("Converted '"), v, F.lit("' to a number."))
        # a value that already reads as its double text is not recorded
        recorded = new.isNotNull() & (new.cast("string") != text.strip(v))
        return F.when(recorded, repair.outcome(new, "type_conversion", 0.95, note)).otherwise(repair.unchanged(new))

    return t.step(dict.fromkeys(numeric, convert))


def impute_missing(
    t: Audited,
    columns: Sequence[str] | None = None,
    numeric_strategy: str = "median",
) -> Audited:
    """Numbers by mean, median or mode; texts by mode; dates by the previous, else the next value."""
    chosen = [c for c in t.columns if columns is None or c in columns]
    kinds = column_types(t.frame)
    data = t.data
    holes = first_row(data.agg(*[count_where(col(c).isNull()).alias(c) for c in chosen])) if chosen else {}
    chosen = [c for c in chosen if holes[c]]
    numeric = numeric_columns(data, chosen) if chosen else []
    texts = [c for c in chosen if kinds[c] in (STRING, BOOLEAN)]
    days = [c for c in chosen if kinds[c] == DATETIME]

    plan: dict[str, tuple[Column, str, float, str]] = {}
    if numeric_strategy == "mean":
        values = fill.means(data, numeric)
        plan |= {c: (F.lit(v), "mean_imputation", 0.85, f"Filled with mean ({v}).") for c, v in values.items() if v is not None}
    elif numeric_strategy == "median":
        values = fill.medians(data, numeric)
        plan |= {c: (F.lit(v), "median_imputation", 0.90, f"Filled with median ({v}).") for c, v in values.items() if v is not None}
    by_mode = texts + (numeric if numeric_strategy == "mode" else [])
    for c, v in modes(data, by_mode).items():
        if v is not None:
            confidence = 0.75 if c in numeric else 0.80
            plan[c] = (mode_literal(data, c, v), "mode_imputation", confidence, f"Filled with mode ('{v}').")

    def filler(value: Column, method: str, confidence: float, reason: str) -> Callable[[Column], Column]:
        return lambda v: F.when(v.isNull(), repair.outcome(value, method, confidence, reason)).otherwise(
            repair.unchanged(F.coalesce(v, value))
        )

    out = t.step({c: filler(*p) for c, p in plan.items()})
    return _fill_days(out, days) if days else out


def _fill_days(t: Audited, days: list[str]) -> Audited:
    olds = {c: f"__old{i}" for i, c in enumerate(days)}
    frame = t.frame.withColumns({o: col(c) for c, o in olds.items()})
    frame = fill_along(frame, days, t.row_id)
    frame = fill_along(frame, days, t.row_id, backward=True)
    entries = [
        F.when(
            F.col(o).isNull() & col(c).isNotNull(),
            entry(c, F.col(o), col(c), F.lit("ffill_bfill"), F.lit(0.70), F.lit("Filled with the nearest known value.")),
        )
        for c, o in olds.items()
    ]
    grown = F.concat(F.col(LOG), F.array_compact(F.array(*entries)))
    return replace(t, frame=frame.withColumn(LOG, grown).drop(*olds.values()))


def flag_outliers(t: Audited, columns: Sequence[str] | None = None, method: str = "iqr") -> Audited:
    """Record outlying numbers by iqr, zscore or modified_zscore; values and rows stay."""
    data = t.data
    chosen = [c for c in numeric_columns(data, columns) if c != t.row_id]
    flags: dict[str, tuple[Column, str]] = {}
    if method == "iqr":
        confidence = 0.90
        for c, (low, high, _) in scale.iqr_bounds(data, chosen).items():
            flags[c] = (scale.outside(c, low, high), f"Outside [{round(low, 2)}, {round(high, 2)}]. Row kept.")
    elif method == "zscore":
        confidence = 0.85
        for c, (mean, std) in scale.moments(data, chosen).items():
            if std:
                flags[c] = (F.abs(scale.z_score(c, mean, std)) > scale.Z_LIMIT, "z-score beyond 3. Row kept.")
    elif method == "modified_zscore":
        confidence = 0.88
        middle = {c: v[0] for c, v in exact_quantiles(data, chosen, [0.5]).items()}
        for c, mad in median_absolute_deviation(data, middle).items():
            if mad:
                distance = F.abs(F.lit(scale.MODIFIED_Z_SCALE) * (col(c) - F.lit(middle[c])) / F.lit(mad))
                flags[c] = (distance > scale.MODIFIED_Z_LIMIT, "Modified z-score beyond 3.5. Row kept.")
    else:
        raise ValueError(f"unknown outlier method '{method}'")
    entries = [
        F.when(hit, entry(c, col(c), col(c), F.lit(f"{method}_outlier_flag"), F.lit(confidence), F.lit(reason)))
        for c, (hit, reason) in flags.items()
    ]
    if not entries:
        return t
    grown = F.concat(F.col(LOG), F.array_compact(F.array(*entries)))
    return replace(t, frame=t.frame.withColumn(LOG, grown))


def remove_exact_duplicates(t: Audited, max_deletion_pct: float = MAX_DELETION_PCT) -> Audited:
    """Keep the first of identical rows, unless more than 5 % of the rows would go: then halt.

    The copies are combined before the shuffle, and rows are removed by their unique id, so a
    row repeated by a third of the table meets no hot key. They are dealt out by their id before, as
    the copies of a file read by one task would fill that task's memory. An id that is data of the
    caller's table is compared like any column; only one that ``add_row_id`` made or ``mark_row_id`` marked is not.
    """
    compared = t.columns if is_generated(t.frame, t.row_id) else [t.row_id, *t.columns]
    keep_id = F.min(col(t.row_id)).alias("__first")
    dealt = spread(t.frame.select(*[col(c) for c in dict.fromkeys([t.row_id, *compared])]), t.row_id)
    first = dealt.groupBy(*[col(c) for c in compared]).agg(
        keep_id, F.count(F.lit(1)).alias("__copies")
    )
    counted = first.agg(F.coalesce(F.sum("__copies"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = counted
    extra = total - distinct
    if extra == 0:
        return t
    pct = extra / total * 100
    if pct > max_deletion_pct:
        reason = f"Removing duplicates would delete {round(pct, 2)}% of the rows (limit {max_deletion_pct}%)."
        return replace(t, halted=True, halt_reason=reason)
    keep = first.select(F.col("__first").alias(t.row_id))
    kept = t.frame.join(keep, t.row_id, "left_semi")
    gone = t.frame.select(col(t.row_id)).join(keep, t.row_id, "left_anti")
    return t.remove(kept, gone, "duplicate row", "exact_duplicate_removal", "Same as an earlier row.")


def remove_empty_rows(t: Audited) -> Audited:
    empty = rows.is_empty_row(t.frame, t.columns)
    kept, gone = t.frame.where(~empty), t.frame.where(empty).select(col(t.row_id))
    return t.remove(kept, gone, "empty row", "empty_row_removal", "Every cell was missing or blank.")


STEPS: dict[str, Callable[..., Audited]] = {
    "normalize_sentinels": normalize_sentinels,
    "clean_text": clean_text,
    "standardize_names": standardize_names,
    "standardize_categories": standardize_categories,
    "repair_emails": repair_emails,
    "standardize_dates": standardize_dates,
    "standardize_phones": standardize_phones,
    "standardize_addresses": standardize_addresses,
    "standardize_urls": standardize_urls,
    "convert_data_types": convert_data_types,
    "impute_missing": impute_missing,
    "flag_outliers": flag_outliers,
    "remove_exact_duplicates": remove_exact_duplicates,
    "remove_empty_rows": remove_empty_rows,
}
ROW_LOCAL = tuple(STEPS)[:9]
_WHOLE_ROW = ("remove_exact_duplicates", "remove_empty_rows")


@dataclass(frozen=True)
class SmartResult:
    """What the pipeline gives back. With ``dry_run`` the data is the input."""

    data: DataFrame
    audit: DataFrame
    before: DataFrame
    halted: bool
    halt_reason: str

    @property
    def summary(self) -> DataFrame:
        """One row ``(rows_before, rows_after, cells_changed, halted, halt_reason)``."""
        counted = rows.row_change(self.before, self.data)
        both = counted.unionByName(cells_changed(self.audit), allowMissingColumns=True)
        return both.agg(
            F.max("rows_before").alias("rows_before"),
            F.max("rows_after").alias("rows_after"),
            F.max("cells_changed").alias("cells_changed"),
            F.lit(self.halted).alias("halted"),
            F.lit(self.halt_reason).alias("halt_reason"),
        )


def smart_clean(
    df: DataFrame,
    row_id: str | None = None,
    steps: Sequence[str] | None = None,
    columns: Sequence[str] | None = None,
    dry_run: bool = False,
    materialize: bool = True,
) -> SmartResult:
    """Run the audited steps in their fixed order (or a subset of steps and columns).

    Steps 1 to 9 are one projection. Steps 10 to 13 each measure the table before they act, so the
    cleaned rows are written once, as Parquet in the shared folder, and measured there column by
    column; ``materialize=False`` recomputes them for each measure instead. A halt skips the two
    removing steps.
    """
    unknown = [s for s in steps or () if s not in STEPS]
    if unknown:
        raise ValueError(f"unknown steps: {', '.join(unknown)}")
    if row_id is None:
        row_id = "row_id"
        df = add_row_id(df, row_id)
    t = Audited.start(df, row_id)
    wanted = [s for s in STEPS if steps is None or s in steps]
    for s in wanted:
        if s not in ROW_LOCAL and materialize:
            t, materialize = replace(t, frame=stored(t.frame, "cleaned")), False
        if s in _WHOLE_ROW:
            if not t.halted:
                t = STEPS[s](t)
        else:
            t = STEPS[s](t, columns)
    return SmartResult(df if dry_run else t.data, t.audit, df, t.halted, t.halt_reason)
