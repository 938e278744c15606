"""Nearest neighbours over an array column, and metadata handling of vector rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.operators.rows import find
from tablesmith.types import col, require_columns

# Query vectors of one batch travel in the plan as literals.
MAX_QUERIES = 1_000
# Metadata names that hold the row itself.
_RESERVED = ("id", "embedding", "document")


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, summed in double."""
    gaps = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g)


def _literal(vector: Sequence[float]) -> Column:
    return F.lit([float(x) for x in vector])


def vector_search(
    df: DataFrame,
    vector: Sequence[float],
    id_column: str,
    vector_column: str,
    top_k: int = 5,
    where: Mapping[str, object] | None = None,
) -> DataFrame:
    """The ``top_k`` rows nearest to ``vector`` among those whose metadata equal ``where``.

    One pass: each task keeps its own ``top_k`` and only those are merged. Rows whose vector has
    another length are not comparable and left out. Ties go to the smaller id.
    """
    require_columns(df, [id_column, vector_column])
    if not vector:
        raise ValueError("vector_search needs a query vector")
    if top_k < 1:
        raise ValueError("top_k must be positive")
    rows = find(df, where).where(F.size(col(vector_column)) == len(vector))
    scored = rows.withColumn("distance", squared_l2(col(vector_column), _literal(vector)))
    return scored.orderBy("distance", col(id_column)).limit(top_k).drop(vector_column)


def vector_search_batch(
    df: DataFrame, queries: Mapping[int, Sequence[float]], id_column: str, vector_column: str, top_k: int = 5
) -> DataFrame:
    """``(query_id, id, distance, place)`` for a batch of query vectors.

    Up to ``MAX_QUERIES`` vectors travel in the plan, more go as a table through ``knn.knn_join``. The
    table is read once for all of them. Every task ranks its own rows per query first
    (Spark's window group limit), so at most ``top_k`` rows per query and task are shuffled.
    """
    require_columns(df, [id_column, vector_column])
    if not queries:
        raise ValueError("a batch holds at least one query vector")
    if len(queries) > MAX_QUERIES:
        from tablesmith.operators.knn import knn_join  # which needs this module's distance

        asked = df.sparkSession.createDataFrame([(k, [float(x) for x in v]) for k, v in queries.items()], "query_id bigint, probe array<double>")
        return knn_join(df, asked, id_column, vector_column, "query_id", "probe", top_k).data
    batch = F.array(
        *[F.struct(F.lit(k).cast("bigint").alias("query_id"), _literal(v).alias("probe")) for k, v in queries.items()]
    )
    pairs = df.select(col(id_column).alias("id"), col(vector_column).alias("v"), F.inline(batch))
    scored = pairs.where(F.size("v") == F.size("probe")).select(
        "query_id", "id", squared_l2(F.col("v"), F.col("probe")).alias("distance")
    )
    place = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return scored.withColumn("place", place).where(F.col("place") <= top_k)


def normalize_metadata(df: DataFrame, id_column: str = "id", vector_column: str = "embedding") -> DataFrame:
    """``(id, embedding, metadata)``: the other columns as a text map.

    Nested values become JSON, nulls are dropped, reserved names are skipped, a missing id is drawn.
    """
    kept = [f for f in df.schema.fields if f.name not in {id_column, vector_column, *_RESERVED}]
    nested = (T.ArrayType, T.MapType, T.StructType)
    pairs = [
        F.struct(
            F.lit(f.name).alias("key"),
            (F.to_json(col(f.name)) if isinstance(f.dataType, nested) else col(f.name).cast("string")).alias("value"),
        )
        for f in kept
    ]
    known = F.filter(F.array(*pairs), lambda p: p.getField("value").isNotNull()) if pairs else None
    metadata = F.map_from_entries(known) if pairs else F.create_map().cast("map<string,string>")
    row_id = F.coalesce(col(id_column).cast("string"), F.uuid()) if id_column in df.columns else F.uuid()
    return df.select(row_id.alias("id"), col(vector_column).alias("embedding"), metadata.alias("metadata"))
