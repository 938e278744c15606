"""Row order: dense row ids, and fills that look along the order without one giant window."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.session import durable
from tablesmith.types import col, select_columns

# Rows per slice of the order, and the most slices (their carry table is broadcast).
SLICE_ROWS = 1_000_000
MAX_SLICES = 20_000


_GENERATED = "tablesmith.generated_row_id"


def mark_row_id(df: DataFrame, name: str) -> DataFrame:
    """Say that a column numbers the rows and is no data of theirs, as ``add_row_id`` does."""
    return df.withColumn(name, col(name).alias(name, metadata={**df.schema[name].metadata, _GENERATED: True}))


def is_generated(df: DataFrame, name: str) -> bool:
    return bool(df.schema[name].metadata.get(_GENERATED))


def add_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Dense 0-based ids in row order, marked as no data of the rows.

    The partition-local counter is written to durable storage first, so a lost executor
    cannot renumber rows; the offset table has one row per partition.
    """
    tagged = durable(
        df.withColumn("__at", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__at", 33))
        .withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    )
    parts = tagged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    numbered = (
        tagged.join(F.broadcast(starts), "__part")
        .withColumn(name, F.col("__start") + F.col("__at"))
        .drop("__part", "__at", "__start")
    )
    return mark_row_id(numbered, name)


def _slice_order(df: DataFrame, row_id: str, slice_rows: int) -> tuple[DataFrame, int]:
    """Add ``__slice``: consecutive ranges of ``row_id``, each of about ``slice_rows`` rows.

    The borders are literals, so every recomputation of a lost task sees the same slices.
    """
    kind = df.schema[row_id].dataType
    if isinstance(kind, T.NumericType):
        position = col(row_id).cast("double")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        position = F.unix_micros(col(row_id).cast("timestamp")).cast("double")
    else:
        raise ValueError(f"'{row_id}' must be numeric or a date/time to order rows")
    rows = df.count()
    slices = min(MAX_SLICES, math.ceil(rows / slice_rows))
    if slices <= 1:
        return df.withColumn("__slice", F.lit(0.0)), 1
    shares = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    borders = df.agg(F.percentile_approx(position, shares, F.lit(max(10_000, 10 * slices)))).first()[0]
    splits = [-math.inf, *sorted(set(borders)), math.inf]
    cut = Bucketizer(splits=splits, inputCol="__position", outputCol="__slice", handleInvalid="keep")
    return cut.transform(df.withColumn("__position", position)).drop("__position"), len(splits) - 1


def fill_along(
    df: DataFrame, columns: Sequence[str] | None, row_id: str, backward: bool = False, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Forward (or backward) fill of nulls in ``row_id`` order.

    Inside a slice a window does it. What a slice hands to its neighbours is its last known
    value: one row per slice, whose own running fill is broadcast back.
    """
    columns = [c for c in select_columns(df, columns) if c != row_id]
    sliced, slices = _slice_order(df, row_id, slice_rows)
    order = col(row_id).desc() if backward else col(row_id).asc()
    so_far = W.partitionBy("__slice").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = {c: F.last(col(c), ignorenulls=True).over(so_far) for c in columns}
    if slices == 1:
        return sliced.withColumns(local).drop("__slice")
    pick = F.min_by if backward else F.max_by
    ends = sliced.groupBy("__slice").agg(
        *[pick(col(c), F.when(col(c).isNotNull(), col(row_id))).alias(f"__end{i}") for i, c in enumerate(columns)]
    )
    step = F.col("__slice").desc() if backward else F.col("__slice").asc()
    before = W.orderBy(step).rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(
        "__slice", *[F.last(f"__end{i}", ignorenulls=True).over(before).alias(f"__in{i}") for i in range(len(columns))]
    )
    joined = sliced.withColumns(local).join(F.broadcast(carried), "__slice", "left")
    filled = joined.withColumns({c: F.coalesce(col(c), F.col(f"__in{i}")) for i, c in enumerate(columns)})
    return filled.select(*[col(c) for c in df.columns])
