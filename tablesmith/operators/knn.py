"""Exact nearest neighbours of many query rows, with lists around centres and triangle-inequality bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.session import durable, scratch_path
from tablesmith.types import col, require_columns

# Centres are fitted to a sample of at most so many rows, and there are at most so many of them.
SAMPLE_ROWS = 20_000
MAX_CENTRES = 512
PART_ROWS = 4_096  # rows of a list that meet the queries together
PART_QUERIES = 1_024  # queries that meet such a part together
_MAX_TASKS = 20_000
_SLACK = 1e-6  # relative, for bounds that rounding may miss


@dataclass(frozen=True)
class Neighbours:
    """``data``: ``query_id``, ``id``, ``distance`` (squared), ``place``; ``summary``: one row with the work done."""

    data: DataFrame
    summary: DataFrame


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def _centres(rows: DataFrame, n: int, size: int) -> np.ndarray:
    """Centres of about sqrt(n) lists, fitted to a bounded sample of the vectors of ``size`` components."""
    k = max(1, min(MAX_CENTRES, math.isqrt(n)))
    share = max(1, math.ceil(n / SAMPLE_ROWS))
    sample = rows.where((F.size("v") == size) & (F.pmod(F.xxhash64("v"), F.lit(share)) == 0)).select(array_to_vector("v").alias("features")).limit(2 * SAMPLE_ROWS)
    if sample.limit(2).count() < 2 or k < 2:
        return np.zeros((1, size))
    return np.array(KMeans(k=k, seed=7, maxIter=5).fit(sample).clusterCenters())


def _distances(vectors: pa.ListArray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of the centres' length, and their distances to all centres."""
    size = np.diff(vectors.offsets.to_numpy())
    at = np.flatnonzero(size == centres.shape[1])
    flat = vectors.flatten().to_numpy().astype(float)
    start = np.cumsum(size) - size
    x = flat[start[at][:, None] + np.arange(centres.shape[1])] if len(at) else np.zeros((0, centres.shape[1]))
    out = np.empty((len(at), len(centres)))
    for j, c in enumerate(centres):
        out[:, j] = np.sqrt(((x - c) ** 2).sum(axis=1))
    return at, out


def _listed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``list`` and ``r`` (distance to its centre) of each row; vectors of another length have a list of their length."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            lists = -np.diff(vectors.offsets.to_numpy()).astype(np.int64)
            r = np.zeros(len(vectors))
            at, d = _distances(vectors, shared.value)
            if len(at):
                lists[at] = d.argmin(axis=1)
                r[at] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists), pa.array(r)], names=["id", "v", "list", "r"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, v array<double>, list long, r double")


def _probes(queries: DataFrame, centres: np.ndarray, lists: dict[int, tuple[float, int]], top_k: int) -> DataFrame:
    """For each query the lists to look at. Without ``bound`` the nearest ones that hold ``top_k`` rows together;
    with it all others that may hold a row within that distance. ``d`` is the distance to the list's centre."""
    shared = queries.sparkSession.sparkContext.broadcast((centres, lists))
    bounded = "bound" in queries.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, lists = shared.value
        live = np.array(sorted(k for k in lists if k >= 0), np.int64)
        radius, rows = (np.array([lists[k][i] for k in live.tolist()], float) for i in (0, 1))
        for batch in batches:
            vectors = batch.column(1)
            size = np.diff(vectors.offsets.to_numpy())
            place = {int(i): k for k, i in enumerate(at_d[0])} if (at_d := _distances(vectors, centres)) else {}
            bounds = batch.column(2).to_pylist() if bounded else None
            of, to, far = [], [], []
            for i, n in enumerate(size.tolist()):
                if i not in place:
                    if not bounded and -n in lists:  # the one list of its length
                        of.append(i)
                        to.append(-n)
                        far.append(None)
                    continue
                d = at_d[1][place[i]][live]
                order = np.argsort(d, kind="stable")
                first = order[: 1 + int(np.searchsorted(np.cumsum(rows[order]), top_k))]
                if bounded:
                    least = d - radius - _SLACK * (d + radius)
                    near = np.flatnonzero(least <= (np.inf if bounds[i] is None else bounds[i]))
                    first = np.setdiff1d(near, first)
                of += [i] * len(first)
                to += live[first].tolist()
                far += d[first].tolist()
            at = pa.array(of, pa.int64())
            keep = [c.take(at) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(to, pa.int64()), pa.array(far, pa.float64())], names=[*batch.schema.names, "list", "d"])

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.mapInArrow(work, f"query_id {kind}, probe array<double>, {'bound double, ' if bounded else ''}list long, d double")


def _nearest(top_k: int, bounded: bool):
    """The ``top_k`` nearest rows of one part for each of some queries, as a function of both tables.

    One product of matrices bounds all distances; those that may be among the nearest are then summed
    component by component, as ``squared_l2`` does. ``n`` is how many rows a query was compared with.
    """

    def matrix(lists: pa.ChunkedArray) -> np.ndarray:
        flat = lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
        return flat.reshape(len(lists), -1)

    def work(queries: pa.Table, rows: pa.Table) -> pa.Table:
        of, to, distance, n = [], [], [], []
        if queries.num_rows and rows.num_rows:
            rows = rows.take(pc.sort_indices(rows.column("id").combine_chunks(), null_placement="at_start"))  # ties go to the smaller id
            p, x = matrix(queries.column("probe")), matrix(rows.column("v"))
            size = (p**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)
            about = size - 2 * (p @ x.T)
            # huge components leave no bound
            loose = np.where(np.isfinite(about), 1e-9 * size, np.inf)
            low = np.where(np.isfinite(about), about - loose, -np.inf)
            high = np.where(np.isfinite(about), about + loose, np.inf)
            live = np.ones(about.shape, bool)
            if bounded:
                d, r = queries.column("d").to_numpy()[:, None].astype(float), rows.column("r").to_numpy()
                bound = queries.column("bound").to_numpy()[:, None].astype(float)
                gap = np.abs(d - r) - _SLACK * (d + r)
                live = np.isnan(d) | np.isnan(bound) | (gap <= bound)
            low, high = np.where(live, low, np.inf), np.where(live, high, np.inf)
            k = min(top_k, x.shape[0]) - 1
            reach = np.partition(high, k, axis=1)[:, k]
            for i in range(len(p)):
                at = np.flatnonzero(live[i] & (low[i] <= reach[i]))
                exact = np.zeros(len(at))
                for j in range(p.shape[1]):
                    gaps = x[at, j] - p[i, j]
                    exact += gaps * gaps
                best = np.argsort(exact, kind="stable")[:top_k]
                of += [i] * len(best)
                to += at[best].tolist()
                distance += exact[best].tolist()
                n += [int(live[i].sum())] * min(len(best), 1) + [0] * (len(best) - 1)
        cols = [queries.column("query_id").take(pa.array(of, pa.int64())), rows.column("id").take(pa.array(to, pa.int64()))]
        return pa.table([*cols, pa.array(distance, pa.float64()), pa.array(n, pa.int64())], names=["query_id", "id", "distance", "n"])

    return work


def _best(found: DataFrame, top_k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_k)


def knn_join(rows: DataFrame, queries: DataFrame, id_column: str, vector_column: str, query_id: str, query_vector: str, top_k: int = 5) -> Neighbours:
    """The ``top_k`` nearest rows of each query row, exact, for any number of queries.

    Rows lie in lists around centres; lists are cut into parts of bounded size. A query first looks
    through the nearest lists that hold ``top_k`` rows. The distance it has then bounds what is left: a list
    whose centre is further than that distance plus the list's radius is skipped, and in the others each
    row whose distance to the centre alone rules it out. Ties go to the smaller id. Vectors are only
    compared with vectors of their length; those that are null, empty or hold a null, NaN or infinite
    component are in no result. ``query_id`` must be unique and known.
    """
    require_columns(rows, [id_column, vector_column])
    require_columns(queries, [query_id, query_vector])
    if top_k < 1:
        raise ValueError("top_k must be positive")
    spark = rows.sparkSession
    double = lambda c: col(c).cast("array<double>")
    table = rows.select(col(id_column).alias("id"), double(vector_column).alias("v")).where(_usable(F.col("v")))
    asked = queries.select(col(query_id).alias("query_id"), double(query_vector).alias("probe")).where(_usable(F.col("probe")))
    common = table.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size, n = (common["size"], common["count"]) if common else (1, 0)
    centres = _centres(table, n, size)
    path = scratch_path(spark, "knn")
    _listed(table, centres).withColumn("salt", F.xxhash64("id")).write.parquet(path)
    listed = spark.read.parquet(path)

    # at most MAX_CENTRES lists, and one for each other length
    counts = listed.groupBy("list").agg(F.max("r").alias("radius"), F.count(F.lit(1)).alias("n")).collect()
    lists = {r["list"]: (r["radius"], r["n"]) for r in counts}
    parts = spark.createDataFrame([(k, max(1, -(-m // PART_ROWS))) for k, (_, m) in lists.items()], "list long, parts int")
    dealt = listed.join(F.broadcast(parts), "list").withColumn("part", F.pmod("salt", "parts").cast("int"))

    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {table.schema['id'].dataType.simpleString()}, distance double, n long"

    def met(probes: DataFrame) -> DataFrame:
        probes = durable(probes)
        asks = {r["list"]: r["count"] for r in probes.groupBy("list").count().collect()}  # a row for each list
        chunks = spark.createDataFrame([(k, -(-m // PART_QUERIES)) for k, m in asks.items()], "list long, chunks int")
        tasks = sum(m * lists[k][1] for k, m in asks.items()) / (PART_ROWS * PART_QUERIES)
        tasks = min(max(math.ceil(tasks), spark.sparkContext.defaultParallelism), _MAX_TASKS)
        each = probes.join(F.broadcast(parts), "list").join(F.broadcast(chunks), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        each = each.withColumn("chunk", F.pmod(F.xxhash64("query_id"), "chunks").cast("int")).drop("parts", "chunks")
        held = dealt.drop("parts", "salt").join(F.broadcast(chunks), "list").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        # a part is small in bytes and long in work: keep the tasks from being merged by size
        sides = [t.repartition(tasks, "list", "part", "chunk").groupBy("list", "part", "chunk") for t in (each, held)]
        return sides[0].cogroup(sides[1]).applyInArrow(_nearest(top_k, "bound" in probes.columns), kinds)

    near = durable(met(_probes(asked, centres, lists, top_k)))
    first = durable(_best(near, top_k))
    kth = first.where(F.col("place") == top_k).select("query_id", F.sqrt("distance").alias("bound"))
    bounded = asked.join(kth, "query_id", "left").select("query_id", "probe", "bound")
    far = durable(met(_probes(bounded, centres, lists, top_k)))
    data = _best(first.drop("place").unionByName(far), top_k).drop("n")
    work = near.unionAll(far).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("compared"))
    every = asked.groupBy(F.size("probe").alias("size")).count().join(table.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("rows")), "size")
    every = every.agg(F.coalesce(F.sum(F.col("count") * F.col("rows")), F.lit(0)).alias("pairs"))
    summary = work.crossJoin(every).select("pairs", "compared", F.when(F.col("pairs") > 0, 1 - F.col("compared") / F.col("pairs")).alias("skipped_share"))
    return Neighbours(data, summary)
