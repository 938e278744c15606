"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.session import durable


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: for each node of the edges (``a``, ``b``) the least node it reaches.

    Alternating stars: each round hangs the larger neighbours of every node, then the smaller ones,
    on its least neighbour, until nothing changes; rounds grow with the logarithm of the longest
    path. Each round is written to the shared folder, so lineage stays short. Minima combine before
    the shuffle, and the joins are plain ones whose hot keys Spark can split.
    """
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, mark = None, _mark(now)
    while mark != before and mark[0]:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        now = durable(small.where("a <> b").distinct())
        before, mark = mark, _mark(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select("b", "b").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
