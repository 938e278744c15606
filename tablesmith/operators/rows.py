"""Row operators: filter, search, sort, page, sample, deduplicate, find, update, delete."""

from __future__ import annotations

import functools
import math
import operator
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.functions import text
from tablesmith.operators.ordering import is_generated
from tablesmith.types import FLOAT, INTEGER, col, column_types, require_columns, select_columns


def _any_of(conditions: Sequence[Column]) -> Column:
    return functools.reduce(operator.or_, conditions)


def _all_of(conditions: Sequence[Column]) -> Column:
    return functools.reduce(operator.and_, conditions)


def contains_text(c: Column, value: str, literal: bool = False) -> Column:
    """Case-insensitive match of a regular expression (or of the literal text)."""
    return F.coalesce(c.cast("string").rlike("(?i)" + (re.escape(value) if literal else value)), F.lit(False))


def search_rows(df: DataFrame, value: str, literal: bool = False) -> DataFrame:
    """Rows where the text of any column matches."""
    return df.where(_any_of([contains_text(col(c), value, literal) for c in df.columns]))


def sort_keys(by: Sequence[tuple[str, str]], tiebreak: str | None = None) -> list[Column]:
    """Sort columns with nulls last in both directions."""
    keys = [col(c).desc_nulls_last() if d == "desc" else col(c).asc_nulls_last() for c, d in by]
    if tiebreak and tiebreak not in [c for c, _ in by]:
        keys.append(col(tiebreak).asc_nulls_last())
    return keys


def sort_rows(df: DataFrame, by: str, direction: str = "asc", row_id: str | None = None) -> DataFrame:
    require_columns(df, [by])
    return df.orderBy(*sort_keys([(by, direction)], row_id))


def page(
    df: DataFrame,
    number: int = 1,
    size: int = 50,
    search: str | None = None,
    sort_by: str | None = None,
    direction: str = "asc",
    row_id: str | None = None,
) -> DataFrame:
    """One page (1-based) of the searched and sorted table; ``size`` is 1..500."""
    if number < 1 or not 1 <= size <= 500:
        raise ValueError("page starts at 1 and page size is 1..500")
    out = search_rows(df, search) if search else df
    if sort_by:
        out = sort_rows(out, sort_by, direction, row_id)
    elif row_id:
        out = sort_rows(out, row_id)
    return out.offset((number - 1) * size).limit(size)


def page_totals(df: DataFrame, size: int = 50, search: str | None = None) -> DataFrame:
    """One row ``(total, total_pages)``; an empty table still has one page."""
    out = search_rows(df, search) if search else df
    pages = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(float(size))), F.lit(1)).cast("bigint")
    return out.agg(F.count(F.lit(1)).alias("total"), pages.alias("total_pages"))


# A fractional bound on whole numbers, as the whole bound that keeps the same rows.
_ROUNDED = {">": (">", math.floor), ">=": (">=", math.ceil), "<": ("<", math.ceil), "<=": ("<=", math.floor)}


def _number(value):
    """A number as int when it is whole, else as float; what is no number stays as it is."""
    try:
        if isinstance(value, (int, str)) and not isinstance(value, bool):
            try:
                return int(value) if abs(int(value)) < 2**63 else float(value)
            except ValueError:
                pass
        number = float(value)
    except (TypeError, ValueError):
        return value
    return int(number) if number.is_integer() and abs(number) < 2**63 else number


def filter_rows(df: DataFrame, column: str, op: str = "==", value=None, literal: bool = False) -> DataFrame:
    """One column/operator/value rule. ``!=`` keeps null rows, the other comparisons drop them."""
    require_columns(df, [column])
    c = col(column)
    kind = column_types(df)[column]
    if kind in (INTEGER, FLOAT) and value is not None and op not in ("contains", "not_contains"):
        value = _number(value)
        if kind == INTEGER and isinstance(value, float) and math.isfinite(value) and op in _ROUNDED:
            op, value = _ROUNDED[op][0], _ROUNDED[op][1](value)  # a whole bound reaches the scan
    rules = {
        "==": lambda: c == F.lit(value),
        "!=": lambda: ~c.eqNullSafe(F.lit(value)),
        ">": lambda: c > F.lit(value),
        ">=": lambda: c >= F.lit(value),
        "<": lambda: c < F.lit(value),
        "<=": lambda: c <= F.lit(value),
        "contains": lambda: contains_text(c, str(value), literal),
        "not_contains": lambda: ~contains_text(c, str(value), literal),
        "is_null": c.isNull,
        "not_null": c.isNotNull,
    }
    if op not in rules:
        raise ValueError(f"unknown filter '{op}'; one of {', '.join(rules)}")
    return df.where(rules[op]())


def drop_nulls(df: DataFrame, how: str = "any", columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(how=how, subset=list(columns) if columns else None)


def remove_empty_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows whose every cell is null or blank."""
    return df.where(~is_empty_row(df, columns))


def is_empty_row(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    return _all_of(
        [F.coalesce(text.strip(col(c).cast("string")) == "", F.lit(True)) for c in select_columns(df, columns)]
    )


def remove_duplicates(df: DataFrame, columns: Sequence[str] | None = None, row_id: str | None = None) -> DataFrame:
    """Keep the first row (in ``row_id`` order) of each combination of ``columns`` (all unless named).

    ``row_id`` is data like any other column and compared too, unless ``add_row_id`` made it or
    ``mark_row_id`` marked it.

    An aggregate, not a window: copies are combined before the shuffle, so a combination held
    by a third of all rows costs one row per task.
    """
    keys = select_columns(df, columns)
    if row_id is None:
        return df.dropDuplicates(keys)
    if columns is None and is_generated(df, row_id):
        keys = [c for c in keys if c != row_id]
    others = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*[col(c) for c in others]), col(row_id))
    kept = df.groupBy(*[col(c) for c in keys]).agg(first.alias("__first"))
    return kept.select(*[F.col("__first").getField(c).alias(c) if c in others else col(c) for c in df.columns])


def sample_rows(
    df: DataFrame, n: int | None = None, frac: float | None = None, seed: int = 42, row_id: str | None = None
) -> DataFrame:
    """A random share of the rows, or exactly ``n`` of them (1,000 by default).

    The exact form orders by a hash of the row, so it is repeatable and keeps ``n`` rows per
    task, not the table.
    """
    if frac is not None:
        if not 0 < frac <= 1:
            raise ValueError("frac must be above 0 and at most 1")
        return df.sample(fraction=float(frac), seed=seed)
    n = 1000 if n is None else int(n)
    if n <= 0:
        raise ValueError("n must be positive")
    keys = [col(row_id)] if row_id else [col(c) for c in df.columns]
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def _matches(df: DataFrame, where: Mapping[str, object]) -> Column:
    require_columns(df, where)
    conditions = [col(c).isNull() if v is None else col(c) == F.lit(v) for c, v in where.items()]
    return F.coalesce(_all_of(conditions), F.lit(False)) if conditions else F.lit(True)


def find(
    df: DataFrame,
    where: Mapping[str, object] | None = None,
    projection: Sequence[str] | None = None,
    sort: Mapping[str, int] | None = None,
    offset: int = 0,
    limit: int | None = None,
) -> DataFrame:
    """Equality-AND query with projection, sort (1 or -1 per column), offset and limit."""
    require_columns(df, [*(projection or []), *(sort or {})])
    out = df
    if where:
        require_columns(df, where)
        out = out.where(_all_of([col(c).isNull() if v is None else col(c) == F.lit(v) for c, v in where.items()]))
    if sort:
        out = out.orderBy(*sort_keys([(c, "desc" if d < 0 else "asc") for c, d in sort.items()]))
    if offset:
        out = out.offset(offset)
    if limit is not None:
        out = out.limit(limit)
    return out.select(*[col(c) for c in projection]) if projection else out


def update_where(df: DataFrame, where: Mapping[str, object], changes: Mapping[str, object]) -> DataFrame:
    """Set columns on the matching rows."""
    require_columns(df, changes)
    hit = _matches(df, where)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    # the condition is kept in its own column: a change may touch a column it reads
    marked = df.withColumn("__hit", hit)
    return marked.withColumns(
        {c: F.when(F.col("__hit"), F.lit(v).cast(kinds[c])).otherwise(col(c)) for c, v in changes.items()}
    ).drop("__hit")


def delete_where(df: DataFrame, where: Mapping[str, object]) -> DataFrame:
    """Remove the matching rows; an empty condition matches every row."""
    return df.where(~_matches(df, where))


def affected_rows(df: DataFrame, where: Mapping[str, object]) -> DataFrame:
    """One row ``(affected)``: how many rows :func:`update_where` or :func:`delete_where` touches."""
    return df.agg(F.count_if(_matches(df, where)).alias("affected"))


def row_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row ``(rows_before, rows_after)``: the effect an operator reports."""
    sides = before.select(F.lit(1).alias("b"), F.lit(0).alias("a")).unionAll(
        after.select(F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    return sides.agg(
        F.coalesce(F.sum("b"), F.lit(0)).cast("bigint").alias("rows_before"),
        F.coalesce(F.sum("a"), F.lit(0)).cast("bigint").alias("rows_after"),
    )
