"""Streams with late and repeated rows against the same operations on the whole table."""

import pytest
from pyspark.sql import functions as F

from tablesmith.operators.forecast import daily_series
from tablesmith.streaming import clean, state

KIND = "id long, ts timestamp, v double, k string"


def _fed(spark, tmp_path, batches, make):
    """The rows that ``make(stream)`` has written once all batches were read, one file a trigger."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "id long, t string, v double, k string").withColumn("ts", F.to_timestamp("t")).select("id", "ts", "v", "k")
        frame.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(KIND).parquet(source)
        clean.append_parquet(make(stream), out, str(tmp_path / "checkpoint")).awaitTermination(120)
    return spark.read.parquet(source), spark.read.parquet(out)


BATCHES = [
    [(1, "2024-01-01 08:00:00", 1.0, "a"), (2, "2024-01-01 09:00:00", 2.0, None), (1, "2024-01-01 08:00:00", 1.0, "a")],
    [(3, "2024-01-02 01:00:00", 5.0, "b"), (2, "2024-01-01 09:00:00", 2.0, None), (4, "2024-01-01 23:00:00", None, "b")],  # late by some hours, within the delay
    [(5, "2024-01-04 12:00:00", 7.0, "c"), (3, "2024-01-02 01:00:00", 5.0, "b"), (6, None, 9.0, "c")],
    [(8, "2024-02-01 00:00:00", 0.0, "end")],
    [(9, "2024-01-01 10:00:00", 100.0, "late")],  # a month behind the watermark
    [(10, "2024-03-01 00:00:00", 0.0, "end")],
]


def test_copies_within_the_delay_go(spark, tmp_path):
    whole, got = _fed(spark, tmp_path, BATCHES, lambda s: state.remove_duplicates_stream(s, "ts", "3 days", ["id", "k"]))
    assert got.columns == ["id", "ts", "v", "k"]
    want = whole.where("id <> 9").dropDuplicates(["id", "k"])
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())


@pytest.mark.parametrize("target", [None, "v"])
def test_days_are_final(spark, tmp_path, target):
    whole, got = _fed(spark, tmp_path, BATCHES, lambda s: state.daily_totals_stream(s, "ts", "2 days", target))
    want = {r.date: r.value for r in daily_series(whole.where("k <> 'late' OR k IS NULL"), "ts", target).where("date < '2024-03-01'").collect()}
    found = {r.date: r.value for r in got.collect()}
    assert found and len(got.collect()) == len(found)  # each day once
    assert {d: v for d, v in want.items() if v} == {d: v for d, v in found.items() if v}


def test_a_time_is_needed(spark):
    table = spark.createDataFrame([(1, "x")], "id long, ts string")
    with pytest.raises(ValueError):
        state.daily_totals_stream(table, "ts", "1 day")
    with pytest.raises(ValueError):
        state.remove_duplicates_stream(table, "when", "1 day")
