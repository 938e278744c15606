"""Row-local operations on a streaming table.

Filters, column operations and the first nine audited steps look at one row at a time, so they
run unchanged on a stream, without state or watermark. What measures the table first (medians,
modes, outlier bounds, duplicates) is refused.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tablesmith.plans import smart
from tablesmith.plans.audit import Audited
from tablesmith.plans.registry import apply_operations

ROW_LOCAL_OPERATIONS = (
    "drop_nulls", "remove_special_chars", "trim_spaces", "change_case", "change_dtype", "rename_column",
    "merge_columns", "drop_columns", "filter_rows", "formula_column",
)


def clean_stream(stream: DataFrame, operations: Sequence[tuple[str, Mapping]]) -> DataFrame:
    """Apply named cleaning operations to a stream."""
    refused = [name for name, _ in operations if name not in ROW_LOCAL_OPERATIONS]
    if refused:
        raise ValueError(f"not row-local: {', '.join(refused)}")
    return apply_operations(stream, operations)


def audited_stream(stream: DataFrame, row_id: str, steps: Sequence[str] = smart.ROW_LOCAL) -> Audited:
    """Apply audited steps to a stream; ``.data`` and ``.audit`` are streams of their own."""
    refused = [s for s in steps if s not in smart.ROW_LOCAL]
    if refused:
        raise ValueError(f"not row-local: {', '.join(refused)}")
    cleaned = Audited.start(stream, row_id)
    for step in smart.ROW_LOCAL:
        if step in steps:
            cleaned = smart.STEPS[step](cleaned)
    return cleaned


def append_parquet(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream to a Parquet table; ``checkpoint`` makes every row arrive exactly once."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).outputMode("append").start()
