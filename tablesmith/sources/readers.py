"""Readers: delimited text, JSON, XML, Parquet, ORC, relational tables, and dispatch by suffix."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Mapping
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.operators.columns import flatten_structs
from tablesmith.sources import splits
from tablesmith.types import col, nan_to_null, q

# Texts a delimited file uses for a missing value.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
_INTEGER = r"^\s*[-+]?\d+\s*$"
_FLOAT = r"(?i)^\s*[-+]?(?:(?:\d+\.?\d*|\.\d+)(?:e[-+]?\d+)?|inf|infinity)\s*$"
_TRUE, _FALSE = ["True", "TRUE", "true"], ["False", "FALSE", "false"]
DELIMITERS = (",", ";", "\t", "|")
_SNIFFED_LINES = 20


def _typed(raw: DataFrame, sample: float | None) -> DataFrame:
    """Give each all-text column the narrowest type all its values fit, found in one pass.

    Dates stay text. With ``sample`` the pass reads that share of the rows; a value outside the
    sample that does not fit its column's type becomes null.
    """
    if not raw.columns:
        return raw
    known = raw.select(*[F.when(~col(c).isin(MISSING_TEXTS), col(c)).alias(c) for c in raw.columns])
    looked = known.sample(fraction=sample, seed=42) if sample else known
    fits = [
        F.struct(
            F.count(col(c)),
            F.bool_and(col(c).rlike(_INTEGER)),
            F.bool_and(F.when(col(c).isNotNull(), F.trim(col(c)).try_cast("bigint").isNotNull())),
            F.bool_and(col(c).rlike(_FLOAT)),
            F.bool_and(col(c).isin(_TRUE + _FALSE)),
        ).alias(f"f{i}")
        for i, c in enumerate(raw.columns)
    ]
    found = looked.agg(*fits).first()

    def cast(c: str, count: int, integer: bool, fitting: bool, number: bool, truth: bool):
        if not count or integer and not fitting:  # longer integers stay text: a double would change them
            return col(c)
        if integer:
            return F.trim(col(c)).try_cast("bigint").alias(c)
        if number:
            return F.trim(col(c)).try_cast("double").alias(c)
        if truth:
            return F.when(col(c).isin(_TRUE), True).when(col(c).isin(_FALSE), False).alias(c)
        return col(c)

    return known.select(*[cast(c, *found[i]) for i, c in enumerate(raw.columns)])


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    schema: T.StructType | str | None = None,
    sample: float | None = None,
    multiline: bool = False,
) -> DataFrame:
    """A delimited file with a header line.

    A given ``schema`` saves the pass that finds the types. ``multiline`` allows line breaks inside
    quotes; such files are read in splits like others, with a pass ahead that finds where quotes are open.
    """
    options = {"sep": sep, "quote": '"', "escape": '"'}
    if multiline:
        raw = _quoted_records(spark, path, options, schema)
    else:
        reader = spark.read.options(**options).option("header", True)
        raw = (reader if schema is None else reader.schema(schema)).csv(path)
    if schema is None:
        return nan_to_null(_typed(raw, sample))
    texts = [f.name for f in raw.schema.fields if isinstance(f.dataType, T.StringType)]
    return nan_to_null(raw.withColumns({c: F.when(~col(c).isin(MISSING_TEXTS), col(c)) for c in texts}))


def _header(text: str, sep: str) -> list[str]:
    """Column names: empty ones are numbered, repeated ones get their number."""
    names = next(csv.reader(io.StringIO(text.removeprefix("\ufeff")), delimiter=sep), [])
    low = [n.lower() for n in names]
    return [f"_c{i}" if not n else n if low.count(n.lower()) == 1 else f"{n}{i}" for i, n in enumerate(names)]


def _quoted_records(spark: SparkSession, path: str, options: dict[str, str], schema: T.StructType | str | None) -> DataFrame:
    found = splits.records(spark, path, splits.delimited(options["sep"])).withColumn("text", F.regexp_replace("text", r"\r$", ""))
    if schema is None:
        head = found.where("first").select("text").first()
        fields = T.StructType([T.StructField(n, T.StringType()) for n in (_header(head[0], options["sep"]) if head else [])])
    else:
        fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not fields:
        return spark.createDataFrame([], fields)
    ddl = ", ".join(f"{q(f.name)} {f.dataType.simpleString()}" for f in fields)
    rows = found.where(~F.col("first")).select(F.from_csv("text", ddl, {**options, "multiLine": "true"}).alias("row"))
    return rows.select(*[F.col("row")[f.name].alias(f.name) for f in fields])


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_delimited(spark, path, ",", **options)


def read_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_delimited(spark, path, "\t", **options)


def read_psv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_delimited(spark, path, "|", **options)


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The candidate that cuts the first lines into the same number (two or more) of fields."""
    lines = [r[0] for r in spark.read.text(path).limit(_SNIFFED_LINES).collect() if r[0].strip()]
    even = {d: lines[0].count(d) for d in DELIMITERS if lines and len({line.count(d) for line in lines}) == 1}
    best = max(even, key=even.get, default=None)
    if not best or not even[best]:
        raise ValueError(f"no delimiter found in '{path}'")
    return best


def read_sniffed(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_delimited(spark, path, sniff_delimiter(spark, path), **options)


def read_json(
    spark: SparkSession, path: str, lines: bool | None = None, schema: T.StructType | str | None = None, flatten: bool = True
) -> DataFrame:
    """JSON records, one per line or in one array; nested objects become dotted columns.

    Which of the two is seen from the first character unless ``lines`` says so. An array is read in
    splits: its objects are written one a line to the shared folder and read from there. Files that hold
    a single object are one task each.
    """
    if not lines:
        head = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
        array = bool(head) and head[0][0].lstrip("\ufeff \t").startswith("[")
        if array:
            path = splits.as_lines(spark, path, splits.json_array(), "json-lines")
        lines = array or lines is None and bool(head)
    reader = spark.read.option("multiLine", not lines)
    df = (reader.schema(schema) if schema is not None else reader).json(path)
    return nan_to_null(flatten_structs(df) if flatten else df)


def read_xml(spark: SparkSession, path: str, row_tag: str = "row", schema: T.StructType | str | None = None) -> DataFrame:
    """The elements named ``row_tag`` as rows.

    Files are read in splits: the elements are written to the shared folder in as many files as there
    are splits, and each of those is read by one task.
    """
    to = splits.as_documents(spark, path, splits.xml_rows(row_tag), f"{row_tag}-rows", "xml-rows")
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return nan_to_null((reader.schema(schema) if schema is not None else reader).load(to))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.orc(path))


READERS: dict[str, Callable[..., DataFrame]] = {
    ".csv": read_csv,
    ".txt": read_sniffed,
    ".tsv": read_tsv,
    ".psv": read_psv,
    ".json": read_json,
    ".jsonl": read_json,
    ".xml": read_xml,
    ".parquet": read_parquet,
    ".orc": read_orc,
}


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read by suffix; an unknown suffix or an empty table is an error."""
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix not in READERS:
        raise ValueError(f"unsupported file type '{suffix}'; one of {', '.join(READERS)}")
    df = READERS[suffix](spark, path, **options)
    if not df.columns or df.isEmpty():
        raise ValueError(f"'{path}' holds no rows")
    return df


def jdbc_options(
    url: str,
    table: str | None = None,
    query: str | None = None,
    partition_column: str | None = None,
    bounds: tuple[object, object] | None = None,
    partitions: int = 8,
    fetch_size: int = 10_000,
    properties: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Options of Spark's JDBC source. With a partition column the table is read in parallel."""
    if (table is None) == (query is None):
        raise ValueError("name either a table or a query")
    out = {"url": url, "fetchsize": str(fetch_size), **(properties or {})}
    if query is not None and partition_column is None:
        return out | {"query": query}
    # Spark partitions a table expression, not a bare query
    out["dbtable"] = table if query is None else f"({query}) t"
    if partition_column is not None:
        if bounds is None:
            raise ValueError("a partitioned read needs bounds")
        out |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return out


def read_table(spark: SparkSession, url: str, table: str | None = None, query: str | None = None, **options) -> DataFrame:
    """A table or query of a relational database (its JDBC driver must be on the class path)."""
    return nan_to_null(spark.read.format("jdbc").options(**jdbc_options(url, table, query, **options)).load())
