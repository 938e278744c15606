"""What tables there are: schema discovery and dataset metadata."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def discover_schema(tables: Mapping[str, DataFrame], counts: bool = True) -> DataFrame:
    """``(table, type, column, position, data_type, nullable, row_count)`` of the given tables.

    Types come from the schemas; the row counts are one pass per table that reads no columns
    (``counts=False`` leaves them null).
    """
    out = None
    for name, df in tables.items():
        fields = [
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(i).alias("position"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.lit(f.nullable).alias("nullable"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
        sized = df.agg(F.count(F.lit(1)).alias("row_count")) if counts else df.sparkSession.range(1).select(F.lit(None).cast("bigint").alias("row_count"))
        part = sized.select(
            F.lit(name).alias("table"), F.lit("table").alias("type"), F.inline(F.array(*fields)), "row_count"
        )
        out = part if out is None else out.unionAll(part)
    if out is None:
        raise ValueError("no tables given")
    return out


def discover_catalog(spark: SparkSession, database: str | None = None, counts: bool = True) -> DataFrame:
    """The same for every table and view of a catalog database."""
    names = [t.name for t in spark.catalog.listTables(database)]
    return discover_schema({n: spark.table(n if database is None else f"{database}.{n}") for n in names}, counts)


def dataset_meta(df: DataFrame) -> DataFrame:
    """One row ``(rows, columns)``."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("bigint").alias("columns"))
