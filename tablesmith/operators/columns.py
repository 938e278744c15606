"""Column operators: rename, split, merge, drop, formula, type change, text cleaning, encoding."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.functions import dates, numbers, text
from tablesmith.operators.ordering import add_row_id
from tablesmith.session import BROADCAST_ROWS
from tablesmith.types import (
    BOOLEAN,
    DATETIME,
    FLOAT,
    INTEGER,
    STRING,
    col,
    column_types,
    require_columns,
    select_columns,
    text_columns,
)

MAX_ONE_HOT = 1_000
# Tokens a formula may not hold.
_BANNED_TOKENS = ("__", "import", "os.", "sys.", "open(", "eval(", "exec(", "lambda")
# Functions that reach outside the row's own columns.
_OUTSIDE_FUNCTIONS = re.compile(r"\b(java_method|reflect|try_reflect|select|input_file_name)\b", re.IGNORECASE)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    """No change when ``old`` does not exist or ``new`` is empty."""
    return df.withColumnRenamed(old, new) if old in df.columns and new else df


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in columns if c in df.columns])


def split_column(df: DataFrame, column: str, delimiter: str = ",") -> DataFrame:
    """Add ``column_1 .. column_k`` with the parts; k is the most parts any row has.

    The width is data, so one small aggregate runs first.
    """
    if column not in df.columns:
        return df
    pattern = F.lit(re.escape(delimiter))
    parts = F.split(col(column).cast("string"), pattern, -1)
    width = df.agg(F.max(F.when(col(column).isNotNull(), F.size(parts)))).first()[0] or 0
    return df.withColumns({f"{column}_{i + 1}": F.get(parts, F.lit(i)) for i in range(width)})


def merge_columns(df: DataFrame, columns: Sequence[str], separator: str = " ", new: str = "merged") -> DataFrame:
    """Join the texts of two or more columns; nulls are skipped."""
    present = [c for c in columns if c in df.columns]
    if len(present) < 2:
        return df
    return df.withColumn(new, F.concat_ws(separator, *[col(c).cast("string") for c in present]))


def formula_column(df: DataFrame, expression: str, new: str = "formula_result") -> DataFrame:
    """A new column from an arithmetic or boolean expression over the others (Spark SQL grammar).

    A division by zero is an error under ANSI; write ``try_divide(a, b)`` to get null.
    """
    expression, new = (expression or "").strip(), (new or "").strip()
    if not expression:
        raise ValueError("formula_column needs an expression")
    if not new:
        raise ValueError("formula_column needs a name for the new column")
    if any(t in expression.lower() for t in _BANNED_TOKENS) or _OUTSIDE_FUNCTIONS.search(expression):
        raise ValueError("the expression holds a token that is not allowed")
    return df.withColumn(new, F.expr(expression))


def change_dtype(df: DataFrame, dtype: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Convert columns to string, int, float, datetime or boolean; what does not convert is null.

    An unknown type leaves the table as it is.
    """
    kinds = column_types(df)

    def convert(c: str):
        v, kind = col(c), kinds[c]
        if dtype == "string":
            return v.cast("string")
        if dtype == "int":
            if kind == STRING:
                return numbers.to_integer(v)
            if kind == FLOAT:
                return F.when(v == F.floor(v), v.try_cast("bigint"))
            return v.try_cast("bigint")
        if dtype == "float":
            return numbers.to_number(v) if kind == STRING else v.try_cast("double")
        if dtype == "datetime":
            return dates.parse_timestamp(v) if kind == STRING else v.try_cast("timestamp_ntz")
        if kind == STRING:
            low = F.lower(F.trim(v))
            return F.when(low.isin("true", "t", "yes", "y", "1"), F.lit(True)).when(
                low.isin("false", "f", "no", "n", "0"), F.lit(False)
            )
        if kind in (INTEGER, FLOAT):
            return F.when(v == 1, F.lit(True)).when(v == 0, F.lit(False))
        return v if kind == BOOLEAN else F.lit(None).cast("boolean")

    if dtype not in ("string", "int", "float", "datetime", "boolean"):
        return df
    chosen = select_columns(df, columns)
    if dtype in ("int", "float"):
        chosen = [c for c in chosen if kinds[c] != DATETIME]
    return df.withColumns({c: convert(c) for c in chosen})


def _on_text(df: DataFrame, columns: Sequence[str] | None, change) -> DataFrame:
    chosen = text_columns(df, columns)
    return df.withColumns({c: change(col(c)) for c in chosen}) if chosen else df


def remove_special_chars(
    df: DataFrame, columns: Sequence[str] | None = None, pattern: str = r"[^A-Za-z0-9\s]"
) -> DataFrame:
    return _on_text(df, columns, lambda c: F.regexp_replace(c, pattern, ""))


def trim_spaces(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _on_text(df, columns, text.strip)


def change_case(df: DataFrame, case: str = "lower", columns: Sequence[str] | None = None) -> DataFrame:
    change = {"lower": F.lower, "upper": F.upper, "title": text.title_case}.get(case)
    return _on_text(df, columns, change) if change else df


def encode_values(df: DataFrame, column: str) -> DataFrame:
    """``(value, code)``: the distinct non-null values, numbered 0.. in ascending order.

    A small set is numbered by a window. A large one is sorted across the cluster and numbered
    by its place in the written sort, so no task sees all of it.
    """
    distinct = df.select(col(column).alias("value")).where("value IS NOT NULL").distinct()
    if distinct.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rank = F.row_number().over(W.orderBy("value")) - 1
        return F.broadcast(distinct.select("value", rank.cast("bigint").alias("code")))
    return add_row_id(distinct.orderBy("value"), "code")


def label_encode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Replace each text column by the rank of its value; null gives -1."""
    out = df
    for c in text_columns(df, columns):
        codes = encode_values(df, c).withColumnsRenamed({"value": "__value", "code": "__code"})
        joined = out.join(codes, col(c) == F.col("__value"), "left")
        code = F.coalesce(F.col("__code"), F.lit(-1)).cast("bigint")
        out = joined.select(*[code.alias(n) if n == c else col(n) for n in out.columns])
    return out


def _free_name(name: str, taken: set[str]) -> str:
    """``name``, numbered where a column of that name (whatever its case) is there; it is taken then."""
    free, n = name, 1
    while free.lower() in taken:
        n += 1
        free = f"{name}_{n}"
    taken.add(free.lower())
    return free


def one_hot_cells(df: DataFrame, row_id: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The set cells of a one-hot table as ``(row_id, column, value)``: any number of values, nulls have none."""
    chosen = [c for c in text_columns(df, columns) if c != row_id]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), col(c).alias("value")) for c in chosen])
    none = F.array().cast("array<struct<column:string,value:string>>")
    return df.select(col(row_id).alias("row_id"), F.inline(cells if chosen else none)).where("value IS NOT NULL")


def one_hot_encode(
    df: DataFrame, columns: Sequence[str] | None = None, max_values: int = MAX_ONE_HOT
) -> DataFrame:
    """Replace each text column by one boolean column per distinct value, in value order.

    The output schema is data, so the distinct values are read first. More than ``max_values``
    of them is an error: a table cannot usefully be that wide, and none may be left out
    (``one_hot_cells`` has no such limit). Names that differ in case only, or are taken, get a number.
    """
    out = df
    for c in text_columns(df, columns):
        found = df.select(col(c).alias("v")).where("v IS NOT NULL").distinct().limit(max_values + 1).collect()
        if len(found) > max_values:
            raise ValueError(f"'{c}' has more than {max_values} distinct values; label_encode suits it better")
        values = sorted(r["v"] for r in found)
        taken = {n.lower() for n in out.columns}
        named = {_free_name(f"{c}_{v}", taken): v for v in values}
        out = out.withColumns({n: col(c).eqNullSafe(F.lit(v)) for n, v in named.items()}).drop(c)
    return out


def flatten_structs(df: DataFrame, separator: str = ".") -> DataFrame:
    """Turn nested struct fields into top-level columns named ``outer.inner``; arrays stay."""

    def leaves(fields, path: list[str]):
        for f in fields:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType.fields, [*path, f.name])
            else:
                yield [*path, f.name]

    def reach(path: list[str]):
        c = col(path[0])
        for step in path[1:]:
            c = c.getField(step)
        return c.alias(separator.join(path))

    return df.select(*[reach(p) for p in leaves(df.schema.fields, [])])
