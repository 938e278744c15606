"""Approximate statistics against exact ones within their bounds; merging; stores that grow."""

import pytest
from pyspark.sql import functions as F

from tablesmith.plans import profile, sketches


@pytest.fixture(scope="module")
def table(spark):
    df = spark.range(60_000).selectExpr(
        "id", "CAST(pow(rand(3), 4) * 1e6 AS DOUBLE) AS skewed", "CASE WHEN id % 5 = 0 THEN NULL ELSE id % 977 END AS many",
        "CASE WHEN id % 3 = 0 THEN 'common' ELSE concat('v', CAST(id % 4000 AS STRING)) END AS text", "CAST(NULL AS DOUBLE) AS nothing", "id % 2 = 0 AS flag",
    )
    return df.repartition(7).cache()


def close(approx, exact, table):
    for name, a in approx.items():
        e = exact[name]
        assert (a.dtype, a.missing, a.missing_pct, a.min, a.max) == (e.dtype, e.missing, e.missing_pct, e.min, e.max), name
        assert all((x is None and y is None) or x == pytest.approx(y, rel=1e-6) for x, y in ((a.mean, e.mean), (a.std, e.std))), name
        assert abs(a.unique - e.unique) <= sketches.DISTINCT_ERROR * e.unique, name
        if e.median is None:
            assert a.median is None
        else:
            known, below, upto = table.agg(F.count(name), F.count_if(F.col(name) < a.median), F.count_if(F.col(name) <= a.median)).first()
            assert below / known - sketches.RANK_ERROR <= 0.5 <= upto / known + sketches.RANK_ERROR
        assert name != "text" or (a.top, a.top_count) == (e.top, e.top_count)


def rows(df):
    return {r.name: r for r in df.collect()}


def test_approximate_statistics_keep_their_bounds(table):
    close(rows(profile.column_stats(table, approx=True)), rows(profile.column_stats(table)), table)


def test_merging_parts_in_any_order(spark, table, monkeypatch):
    exact = rows(profile.column_stats(table))
    monkeypatch.setattr(sketches, "_MERGED_AT_ONCE", 4)
    parts = sketches.sketch_columns(table, part=F.spark_partition_id().cast("string"))
    assert parts.select("part").distinct().count() == 7
    close(rows(sketches.estimate(sketches.merge_sketches(parts))), exact, table)
    halves = [sketches.merge_sketches(parts.where(f"part % 2 = {k}")).withColumn("part", F.lit(str(k))) for k in (1, 0)]
    close(rows(sketches.estimate(sketches.merge_sketches(halves[0].unionByName(halves[1])))), exact, table)


def test_a_store_reads_new_files_only(spark, table, tmp_path):
    data, store = str(tmp_path / "data"), str(tmp_path / "store")
    table.where("id < 20000").repartition(3).write.parquet(data)
    first = sketches.update_store(spark, data, store, ["id", "text"])
    assert first.select("part").distinct().count() == 3 and rows(sketches.estimate(sketches.merge_sketches(first)))["id"].max == 19_999
    table.where("id >= 20000").repartition(2).write.mode("append").parquet(data)
    # the files already known are spoilt: reading them again would fail
    for f in (tmp_path / "data").glob("*.parquet"):
        if any(f.name in r.part for r in first.select("part").distinct().collect()):
            spoilt = f.read_bytes()
            f.write_bytes(spoilt[:4] + bytes(64) + spoilt[68:])
    both = sketches.update_store(spark, data, store, ["id", "text"])
    assert both.select("part").distinct().count() == 5
    got = rows(sketches.estimate(sketches.merge_sketches(both)))
    assert (got["id"].min, got["id"].max, got["id"].missing) == (0, 59_999, 0) and got["text"].top == "common" and got["text"].top_count == 20_000
    again = sketches.update_store(spark, data, store, ["id", "text"])
    assert again.count() == both.count() == 10


def test_empty_tables(table):
    got = rows(profile.column_stats(table.limit(0), approx=True))
    assert len(got) == 6 and all((r.missing, r.unique, r.median, r.top) == (0, 0, None, None) for r in got.values())
