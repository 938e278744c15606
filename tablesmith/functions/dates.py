"""Date recognition: one ordered list of accepted layouts, month first when ambiguous."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_TIME = r"(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:Z|[+-]\d{2}:?\d{2})?)?"

ISO = rf"^(\d{{4}}-\d{{1,2}}-\d{{1,2}}){_TIME}$"
YEAR_FIRST = r"^(\d{4})/(\d{1,2})/(\d{1,2})$"
COMPACT = r"^(\d{4})(\d{2})(\d{2})$"
SLASHED = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
DAY_MONTH_NAME = r"^(\d{1,2}) ([A-Za-z]{3,9})\.? (\d{4})$"
MONTH_NAME_DAY = r"^([A-Za-z]{3,9})\.? (\d{1,2}),? (\d{4})$"


def _month_number(name: Column) -> Column:
    found = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(F.substring(name, 1, 3)))
    return F.when(found > 0, found.cast("string"))


def parse_date(c: Column) -> Column:
    """Text to date, null when no layout fits.

    Each layout is rearranged to ``y-m-d`` by a regex and cast once, so a value that does
    not fit costs pattern checks, never an exception inside the parser.
    """
    t = F.trim(c)

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(t, pattern, group)

    def ymd(pattern: str, y: int, m: int, d: int) -> Column:
        return F.concat_ws("-", part(pattern, y), part(pattern, m), part(pattern, d))

    def named(pattern: str, m: int, d: int) -> Column:
        return F.concat(part(pattern, 3), F.lit("-"), _month_number(part(pattern, m)), F.lit("-"), part(pattern, d))

    def as_date(text: Column) -> Column:
        return text.try_cast("date")

    return (
        F.when(t.rlike(ISO), as_date(part(ISO, 1)))
        .when(t.rlike(SLASHED), F.coalesce(as_date(ymd(SLASHED, 3, 1, 2)), as_date(ymd(SLASHED, 3, 2, 1))))
        .when(t.rlike(YEAR_FIRST), as_date(ymd(YEAR_FIRST, 1, 2, 3)))
        .when(t.rlike(COMPACT), as_date(ymd(COMPACT, 1, 2, 3)))
        .when(t.rlike(DAY_MONTH_NAME), as_date(named(DAY_MONTH_NAME, 2, 1)))
        .when(t.rlike(MONTH_NAME_DAY), as_date(named(MONTH_NAME_DAY, 1, 2)))
    )


def parse_timestamp(c: Column) -> Column:
    """Text to timestamp; a date without a time gives midnight."""
    t = F.trim(c)
    timed = t.rlike(ISO) & t.rlike(r"\d:\d{2}")
    return F.when(timed, t.try_cast("timestamp_ntz")).otherwise(parse_date(c).cast("timestamp_ntz"))
