"""Routing of plain-language requests to operations, over a table of messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.functions import text
from tablesmith.types import categorical_columns, col, numeric_columns, require_columns

# Words of each request, in the order they are tried.
_DUPLICATES = ("remove duplicate", "drop duplicate", "deduplicate")
_MISSING, _DROP = ("missing", "null", "fill"), ("drop", "remove")
_OUTLIERS = ("outlier", "anomal")
_CORRELATION = ("correlation", "correlate")
_SUMMARY = ("summary", "describe", "explain", "overview")
_BARS, _HISTOGRAM = ("bar chart", "top"), ("histogram", "distribution")


def _mentions(c: Column, words: Sequence[str]) -> Column:
    # one pattern, one scan of the message
    return c.rlike("|".join(words))


def find_column(message: Column, names: Sequence[str]) -> Column:
    """The first schema column named in the message, else null."""
    low = F.lower(message)
    return F.coalesce(*[F.when(F.contains(low, F.lit(n.lower())), F.lit(n)) for n in names], F.lit(None))


def route_intents(messages: DataFrame, text_column: str, schema: DataFrame | None = None) -> DataFrame:
    """Add ``action`` and ``params`` (a text map) to each message.

    With ``schema``, chart requests also name the column they are about: the one the message
    mentions, else the first suitable one; a chart without any column falls through.
    """
    require_columns(messages, [text_column])
    m = F.lower(text.strip(col(text_column)))
    none = F.lit(None).cast("string")
    params = {
        "drop_nulls": F.create_map(F.lit("how"), F.lit("any")),
        "remove_outliers": F.create_map(F.lit("method"), F.lit("iqr")),
    }
    bars = histogram = None
    if schema is not None:
        named = find_column(col(text_column), schema.columns)
        bars = F.coalesce(named, F.lit(next(iter(categorical_columns(schema)), None)))
        histogram = F.coalesce(named, F.lit(next(iter(numeric_columns(schema)), None)))
    can_draw = lambda c: F.lit(True) if c is None else c.isNotNull()
    action = (
        F.when(_mentions(m, _DUPLICATES), "remove_duplicates")
        .when(_mentions(m, _MISSING) & _mentions(m, _DROP), "drop_nulls")
        .when(_mentions(m, _MISSING), "auto_fill")
        .when(_mentions(m, _OUTLIERS), "remove_outliers")
        .when(_mentions(m, _CORRELATION), "correlation")
        .when(_mentions(m, _SUMMARY), "profile")
        .when(_mentions(m, _BARS) & can_draw(bars), "value_counts")
        .when(_mentions(m, _HISTOGRAM) & can_draw(histogram), "histogram")
        .otherwise("help")
    )
    routed = messages.withColumn("action", action)
    chosen = F.when(F.col("action") == "drop_nulls", params["drop_nulls"]).when(
        F.col("action") == "remove_outliers", params["remove_outliers"]
    )
    if schema is not None:
        drawn = F.when(F.col("action") == "value_counts", bars).otherwise(histogram)
        charts = F.col("action").isin("value_counts", "histogram")
        chosen = chosen.when(charts, F.create_map(F.lit("column"), F.coalesce(drawn, none)))
    return routed.withColumn("params", chosen.otherwise(F.create_map().cast("map<string,string>")))
