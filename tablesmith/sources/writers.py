"""Writers, and appending rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.types import col


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One record per line; null fields are kept so that every record has all columns."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def append_rows(df: DataFrame, rows: DataFrame, id_column: str | None = None) -> DataFrame:
    """The table with further rows; columns either side lacks are null, missing ids are drawn."""
    out = df.unionByName(rows, allowMissingColumns=True)
    if id_column is None:
        return out
    return out.withColumn(id_column, F.coalesce(col(id_column).cast("string"), F.uuid()))


def append_to(rows: DataFrame, path: str) -> None:
    """Append rows to a Parquet table in place."""
    rows.write.mode("append").parquet(path)
