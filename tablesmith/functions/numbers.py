"""Numeric expressions and text-to-number conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?\s*$"
_MONEY_SIGNS = r"[$€£¥,\s%]"


def looks_numeric(c: Column) -> Column:
    return c.rlike(_NUMBER)


def to_number(c: Column) -> Column:
    """Text to double, null when it is not a number. The pattern keeps out Java suffixes (``5d``)."""
    return F.when(looks_numeric(c), F.trim(c).try_cast("double"))


def to_integer(c: Column) -> Column:
    """Text to bigint; a fractional value gives null."""
    exact = c.rlike(r"^\s*[-+]?\d+\s*$")
    value = to_number(c)
    return F.when(exact, F.trim(c).try_cast("bigint")).otherwise(
        F.when(value == F.floor(value), value.try_cast("bigint"))
    )


def convert_value(c: Column, target: str) -> Column:
    """Value-level converters: int (towards zero), float, percentage (/100), currency."""
    if target in ("int", "integer"):
        value = to_number(F.regexp_replace(c, _MONEY_SIGNS, ""))
        return F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("bigint")
    if target in ("float", "numeric"):
        return to_number(F.regexp_replace(c, _MONEY_SIGNS, ""))
    if target == "percentage":
        return to_number(F.regexp_replace(c, r"[%\s]", "")) / F.lit(100.0)
    if target == "currency":
        return to_number(F.regexp_replace(c, r"[$€£¥,\s]", ""))
    raise ValueError(f"unknown conversion target '{target}'")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, null when whole is zero (ANSI mode would raise)."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, rounded half to even; 0 for an empty whole."""
    return F.coalesce(F.bround(ratio(part, whole) * 100, digits), F.lit(0.0))


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))
