"""Logical column types and the column selectors shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER, FLOAT, BOOLEAN, DATETIME, STRING = "integer", "float", "boolean", "datetime", "string"


def logical_type(dtype: T.DataType) -> str:
    """The six logical names: integer, float, boolean, datetime, string, else Spark's own."""
    if isinstance(dtype, T.IntegralType):
        return INTEGER
    if isinstance(dtype, T.FractionalType):
        return FLOAT
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATETIME
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return STRING
    return dtype.simpleString()


def column_types(df: DataFrame) -> dict[str, str]:
    """Column name to logical type, in schema order."""
    return {f.name: logical_type(f.dataType) for f in df.schema.fields}


def _of_type(df: DataFrame, kinds: Iterable[str], columns: Sequence[str] | None) -> list[str]:
    kinds = set(kinds)
    chosen = set(select_columns(df, columns))
    return [c for c, t in column_types(df).items() if t in kinds and c in chosen]


def select_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Requested columns that exist, in the requested order; all columns when none are named."""
    if not columns:
        return list(df.columns)
    return [c for c in columns if c in df.columns]


def numeric_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Integer and float columns. Booleans count as categorical."""
    return _of_type(df, (INTEGER, FLOAT), columns)


def text_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    return _of_type(df, (STRING,), columns)


def categorical_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    return _of_type(df, (STRING, BOOLEAN), columns)


def datetime_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    return _of_type(df, (DATETIME,), columns)


def named_like(df: DataFrame, keywords: Iterable[str]) -> list[str]:
    """Columns whose lower-cased name contains any keyword (substring match by design)."""
    keywords = tuple(keywords)
    return [c for c in df.columns if any(k in c.lower() for k in keywords)]


def q(name: str) -> str:
    """A column name quoted for ``F.col`` (names may hold dots)."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str):
    return F.col(q(name))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Make NaN and null one kind of missing; applied once, right after reading."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(col(c)), col(c)) for c in floats}) if floats else df


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
