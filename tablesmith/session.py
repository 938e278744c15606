"""Session helpers: durable lineage cuts and scratch folders on shared storage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.types import col

# A side is broadcast only when it was counted and holds at most this many rows and bytes of text form.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session (tests, a laptop) may fall back to a temporary folder:
    on a cluster such a folder would not outlive the executor that wrote it.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tablesmith-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and cut its lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for written tables."""
    return f"{shared_dir(spark).rstrip('/')}/tablesmith-{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over as many partitions as a shuffle makes, and as tasks run at once: a small file of rows with much work each is few partitions.

    Dealt by ``keys`` (unique ones, best), no rows are sorted to deal them.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *[col(k) for k in keys])


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Unlike a checkpoint the copy is columnar: later passes read only the columns they use.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextlib.contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """``keep(df, name)`` as in ``stored``, for tables that only the work inside needs.

    They are deleted on leaving, so what goes on must have been stored outside, or read already.
    """
    paths: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        paths.append(scratch_path(spark, name))
        df.write.parquet(paths[-1])
        return spark.read.parquet(paths[-1])

    try:
        yield keep
    finally:
        for path in paths:
            delete_path(spark, path)


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Inside, what a write or another action shuffled is deleted as it ends, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a table this library wrote below the shared folder."""
    if "/tablesmith-" not in path:
        raise ValueError(f"'{path}' is no scratch table")
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when a bounded look proves the side small in rows and in bytes, else leave
    the join strategy to Spark (sort-merge with AQE skew splitting)."""
    size = F.octet_length(F.to_json(F.struct("*")))
    n, total = df.limit(limit + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= limit and total <= limit_bytes else df


def first_row(df: DataFrame) -> dict:
    """The single row of an aggregate, as a dict."""
    return df.first().asDict()
