"""Text expressions."""

from __future__ import annotations

import functools
import string
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tablesmith.functions.binding import let

# Every character that counts as a blank (Unicode white space and the four ASCII
# separators), for trimming; and the same set as the body of a regex class.
_BLANKS = (
    " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0         "
    "       　"
)
_BLANK_CLASS = r"[ \t-\r\x1c-\x1f\x85\xa0  -     　]"
# a run of blanks that is not already one plain space
_UNEVEN_BLANKS = rf"[{_BLANK_CLASS}&&[^ ]]{_BLANK_CLASS}*| {_BLANK_CLASS}+"

# Texts that stand for a missing value. Compared lower-cased and stripped.
CLEANER_SENTINELS = [
    "", " ", "nan", "na", "n/a", "none", "null", "nil", "missing", "unknown",
    "undefined", "?", "-", "___", "(blank)", "[blank]",
]
PROFILER_SENTINELS = [
    "", " ", "nan", "na", "n/a", "none", "null", "nil", "missing", "unknown",
    "undefined", "?", "-", "_", "0", "0.0", "(blank)", "[blank]",
]


def strip(c: Column) -> Column:
    """Drop leading and trailing blanks of any script (plain ``trim`` drops U+0020 only).

    Trimming a character set looks at the edges; a pattern would scan the whole text.
    """
    return F.trim(c, F.lit(_BLANKS))


def has_edge_space(c: Column) -> Column:
    return strip(c) != c


def collapse_space(c: Column) -> Column:
    return F.regexp_replace(c, _UNEVEN_BLANKS, " ")


def is_sentinel(c: Column, words: list[str] = CLEANER_SENTINELS) -> Column:
    s = strip(c)
    return (F.length(s) <= max(map(len, words))) & F.lower(s).isin(words)


def ascii_upper(c: Column) -> Column:
    return F.translate(c, string.ascii_lowercase, string.ascii_uppercase)


def capitalise_after(c: Column, separators: str) -> Column:
    """Upper-case an ASCII letter at the start and after each separator (a regex class body)."""
    pieces = F.split(c, rf"(?<=[{separators}])", -1)
    raised = F.transform(
        pieces, lambda w: F.concat(ascii_upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))
    )
    return F.array_join(raised, "")


def title_case(c: Column) -> Column:
    """Each run of letters starts upper-case and goes on lower-case, so ``3rd`` gives ``3Rd``."""

    def raised(w: Column) -> Column:
        # a letter whose upper case is two letters (sharp s) keeps only the first of them raised
        rest = F.lower(w.substr(F.lit(2), F.length(w)))
        return let(
            F.upper(F.substring(w, 1, 1)),
            lambda first: F.concat(
                F.when(F.length(first) > 1, F.initcap(first)).otherwise(first), rest
            ),
        )

    # cut before each letter that follows no letter
    return F.array_join(F.transform(F.split(c, r"(?<![\p{L}])(?=[\p{L}])", -1), raised), "")


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


@functools.cache
def _tidy_unicode():
    """Built on first use, of nested functions: they travel to the executors by value, so the
    package need not be installed there."""

    def one(value: str) -> str:
        value = unicodedata.normalize("NFKC", value)
        if not value.replace("\n", " ").replace("\t", " ").isprintable():
            value = "".join(ch for ch in value if ch in "\n\t" or not unicodedata.category(ch).startswith("C"))
        return " ".join(value.split())

    def tidy_batch(values: pd.Series) -> pd.Series:
        return values.map(one, na_action="ignore")

    return F.pandas_udf(tidy_batch, "string")


def _single_spaces(c: Column) -> Column:
    """Runs of spaces become one. Plain replacing halves a run each time and is many times faster
    than a pattern; only a text with a run longer than eight needs the pattern."""
    two, one = F.lit("  "), F.lit(" ")
    halved = F.replace(F.replace(F.replace(c, two, one), two, one), two, one)
    return let(halved, lambda t: F.when(F.contains(t, two), F.regexp_replace(t, " {2,}", " ")).otherwise(t))


def tidy(c: Column) -> Column:
    """NFKC, no invisible characters, any run of blanks as one space, none at the edges.

    Spark has no Unicode normalisation, so texts beyond ASCII go through an Arrow UDF. ASCII texts
    are handed to it as null and stay in the JVM.
    """
    hidden = r"[\x00-\x08\x0b-\x1f\x7f]"
    shown = F.when(c.rlike(hidden), F.regexp_replace(c, hidden, "")).otherwise(c)
    spaced = F.replace(F.replace(shown, F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" "))
    plain = F.trim(_single_spaces(spaced))
    return F.when(is_ascii(c), plain).otherwise(_tidy_unicode()(F.when(~is_ascii(c), c)))


def pattern_signature(c: Column) -> Column:
    """Letters as A, digits as 9, any white space as a blank."""
    blank = F.regexp_replace(c, _BLANK_CLASS, " ")
    return F.regexp_replace(F.regexp_replace(blank, "[a-zA-Z]", "A"), r"\d", "9")
