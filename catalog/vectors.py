"""Nearest-neighbour search."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.tables import table
from tablesmith.operators import knn, vectors


def _distance(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))"


def _probe(spark, sf, ids):
    """Query vectors: the vectors of a few named rows."""
    rows = table(spark, sf, "embeddings").where(F.col("vec_id").isin(ids)).select("vec_id", "embedding").collect()
    return {r["vec_id"]: r["embedding"] for r in rows}


@query("vector_topk", f"SELECT vec_id, label, round(d, 9) AS distance FROM (SELECT e.vec_id, e.label, {_distance('e.embedding', 'q.embedding')} AS d FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY d, vec_id LIMIT 10")
def vector_topk(spark, sf):
    probe = _probe(spark, sf, [0])[0]
    out = vectors.vector_search(table(spark, sf, "embeddings"), probe, "vec_id", "embedding", top_k=10)
    return out.withColumn("distance", F.round("distance", 9))


@query("vector_topk_filtered", f"SELECT vec_id, label, round(d, 9) AS distance FROM (SELECT e.vec_id, e.label, {_distance('e.embedding', 'q.embedding')} AS d FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q WHERE e.label = 3) ORDER BY d, vec_id LIMIT 5")
def vector_topk_filtered(spark, sf):
    probe = _probe(spark, sf, [1])[1]
    out = vectors.vector_search(table(spark, sf, "embeddings"), probe, "vec_id", "embedding", where={"label": 3})
    return out.withColumn("distance", F.round("distance", 9))


@query("vector_knn_batch", f"SELECT query_id, id, round(d, 9) AS distance, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS place FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {_distance('e.embedding', 'q.embedding')} AS d FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id IN (0, 1, 2, 3)) q)) WHERE place <= 5")
def vector_knn_batch(spark, sf):
    probes = _probe(spark, sf, [0, 1, 2, 3])
    out = vectors.vector_search_batch(table(spark, sf, "embeddings"), probes, "vec_id", "embedding")
    return out.withColumn("distance", F.round("distance", 9))


@query("vector_knn_join", f"SELECT query_id, id, round(d, 9) AS distance, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS place FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {_distance('e.embedding', 'q.embedding')} AS d FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0) q)) WHERE place <= 5")
def vector_knn_join(spark, sf):
    """Every twentieth row asks all rows."""
    rows = table(spark, sf, "embeddings")
    out = knn.knn_join(rows, rows.where("vec_id % 20 = 0").select("vec_id", "embedding"), "vec_id", "embedding", "vec_id", "embedding")
    return out.data.withColumn("distance", F.round("distance", 9))


@query("vector_metadata", "SELECT CAST(vec_id AS VARCHAR) AS id, CAST(label AS VARCHAR) AS label, CAST(1 AS INTEGER) AS entries FROM embeddings")
def vector_metadata(spark, sf):
    out = vectors.normalize_metadata(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return out.select("id", F.col("metadata")["label"].alias("label"), F.size("metadata").alias("entries"))
