"""Nearest neighbours of many queries against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesmith.operators import knn, vectors


def brute(rows, queries, top_k):
    out = set()
    for q, v in queries:
        if v is None or not v or not all(x is not None and np.isfinite(x) for x in v):
            continue
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), i) for i, w in rows if w and len(w) == len(v) and all(x is not None and np.isfinite(x) for x in w))
        out |= {(q, i, place) for place, (_, i) in enumerate(near[:top_k], 1)}
    return out


@pytest.mark.parametrize("top_k", [1, 7, 400])
def test_is_brute_force(spark, top_k, monkeypatch):
    monkeypatch.setattr(knn, "PART_ROWS", 50)
    rng = np.random.default_rng(6)
    centres = rng.integers(-20, 20, (8, 4))
    # whole numbers: sums are exact, ties are many; a third of the rows are copies
    rows = [(i, (centres[i % 8] + rng.integers(-2, 3, 4)).astype(float).tolist()) for i in range(400)] + [(400 + i, [3.0, 3.0, 3.0, 3.0]) for i in range(200)]
    rows += [(1000, [1.0, 2.0]), (1001, [2.0, 2.0]), (1002, None), (1003, []), (1004, [1.0, None, 2.0, 3.0]), (1005, [float("nan")] * 4)]
    queries = [(i, (centres[i % 8] + rng.integers(-3, 4, 4)).astype(float).tolist()) for i in range(60)]
    queries += [(900, [1.0, 1.0]), (901, None), (902, [1.0] * 3), (903, [3.0] * 4), (904, [500.0] * 4)]
    table = spark.createDataFrame(rows, "id long, v array<double>").selectExpr("*", "1 AS list", "2 AS r")
    asked = spark.createDataFrame(queries, "q long, w array<float>")
    found = knn.knn_join(table, asked, "id", "v", "q", "w", top_k)
    assert {(r.query_id, r.id, r.place) for r in found.data.collect()} == brute(rows, queries, top_k)
    work = found.summary.first()
    assert 0 < work.compared <= work.pairs and (top_k > 7 or work.skipped_share > 0.5)


def test_small_tables_and_large_batches(spark):
    table = spark.range(3).selectExpr("id", "array(CAST(id AS DOUBLE), 0D) AS v")
    assert knn.knn_join(table.limit(0), table, "id", "v", "id", "v").data.count() == 0
    assert knn.knn_join(table, table.limit(0), "id", "v", "id", "v").data.count() == 0
    batch = {i: [float(i % 3), 0.0] for i in range(1_500)}
    got = vectors.vector_search_batch(table, batch, "id", "v", top_k=1)
    assert got.columns == ["query_id", "id", "distance", "place"]
    assert got.where(F.col("id") == F.col("query_id") % 3).count() == 1_500
    with pytest.raises(ValueError):
        knn.knn_join(table, table, "id", "v", "id", "v", 0)


def test_a_task_hands_on_the_nearest_only(spark, monkeypatch):
    """Of the pairs compared at most ``top_k`` a query and part are written, and queries are cut into chunks."""
    written = []
    durable = knn.durable

    def seen(df):
        out = durable(df)
        if "distance" in out.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(knn, "durable", seen)
    monkeypatch.setattr(knn, "PART_QUERIES", 7)
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(-9, 9, 6).astype(float).tolist()) for i in range(300)]
    table = spark.createDataFrame(rows, "id long, v array<double>")
    found = knn.knn_join(table, table, "id", "v", "id", "v", 2)
    assert {(r.query_id, r.id, r.place) for r in found.data.collect()} == brute(rows, rows, 2)
    assert sum(written) < found.summary.first().compared / 2
