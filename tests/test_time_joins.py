"""As-of and interval joins against brute force, with small slices and bins so that hot keys are split."""

import math
import random

import pytest

from tablesmith.operators.asof import asof_join
from tablesmith.operators.intervals import count_overlaps, interval_join


def _sides(seed, hot):
    rnd = random.Random(seed)
    key = lambda: rnd.choice(["a"] * hot + ["b", "c", None])
    when = lambda: rnd.choice([None, *(rnd.randint(0, 60) for _ in range(12))])
    left = [(i, key(), when()) for i in range(150)]
    right = [(1000 + i, key(), when()) for i in range(120)]
    return left + [left[3], left[3]], right


def _expected(left, right, direction, tolerance, allow_exact, keyed=True):
    out = []
    for i, k, t in left:
        best = None
        if t is not None and (k is not None or not keyed):
            ways = {}
            for j, q, u in right:
                if u is None or keyed and q != k:
                    continue
                for way, gap, rank in (("backward", t - u, (u, j)), ("forward", u - t, (-u, -j))):
                    good = (gap > 0 or gap == 0 and allow_exact) and (tolerance is None or gap <= tolerance)
                    if good and (way not in ways or rank > ways[way][0]):
                        ways[way] = (rank, gap, j)
            if direction == "nearest":
                best = min(((g, w != "backward", j) for w, (_, g, j) in ways.items()), default=(0, 0, None))[2]
            else:
                best = ways.get(direction, (0, 0, None))[2]
        out.append((i, best))
    return sorted(out, key=str)


@pytest.mark.parametrize("slice_rows", [1_000_000, 20])
@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("tolerance, allow_exact", [(None, True), (4, True), (3, False)])
def test_asof(spark, slice_rows, direction, tolerance, allow_exact):
    left, right = _sides(1, 6)
    a = spark.createDataFrame(left, "id long, k string, t int").selectExpr("*", "'x' AS own", "1 AS at")
    b = spark.createDataFrame(right, "id long, k string, t int").selectExpr("*", "2 AS event", "3 AS slice")
    got = asof_join(a, b, "t", "t", ["k"], direction, tolerance, allow_exact, tie="id", slice_rows=slice_rows)
    assert got.columns == ["id_x", "k", "t_x", "own", "at", "id_y", "t_y", "event", "slice"]
    assert sorted(((r.id_x, r.id_y) for r in got.collect()), key=str) == _expected(left, right, direction, tolerance, allow_exact)


def test_asof_without_key_inner_and_times(spark):
    left, right = _sides(2, 1)
    a = spark.createDataFrame(left, "id long, k string, t int").selectExpr("id", "timestamp_seconds(t) AS t")
    b = spark.createDataFrame(right, "rid long, k string, t int").selectExpr("rid", "CAST(timestamp_seconds(t) AS TIMESTAMP_NTZ) AS u")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    got = asof_join(a, b, "t", "u", tolerance=0.5, how="inner", slice_rows=30)
    want = [(i, j) for i, j in _expected(left, right, "backward", 0.5, True, keyed=False) if j is not None]
    assert sorted(((r.id, r.rid) for r in got.collect()), key=str) == want and len(want) > 10


def test_asof_different_key_names_empty_and_errors(spark):
    a = spark.createDataFrame([(1, "k", 5.0), (2, "k", float("inf"))], "id long, key string, t double")
    b = spark.createDataFrame([("k", 4.5, 7)], "name string, t double, v int")
    got = asof_join(a, b, "t", "t", [("key", "name")])
    assert {(r.id, r.v, r.name) for r in got.collect()} == {(1, 7, "k"), (2, 7, "k")}
    assert asof_join(a, b.limit(0), "t", "t", [("key", "name")]).count() == 2
    assert asof_join(a.limit(0), b, "t", "t", [("key", "name")]).count() == 0
    for bad in ({"direction": "sideways"}, {"how": "outer"}, {"tolerance": -1}, {"by": ["none"]}):
        with pytest.raises(ValueError):
            asof_join(a, b, "t", "t", **bad)


def test_no_window_runs_over_a_hot_key(spark):
    a = spark.range(4000).selectExpr("id", "'k' AS k", "id % 1000 AS t")
    got = asof_join(a, a.withColumnRenamed("id", "rid"), "t", "t", ["k"], tie="rid", slice_rows=500)
    assert got.where("rid <> id % 1000 + 3000").count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 2 and "slice" in plan.split("windowspecdefinition", 2)[1].split("]")[0] + plan


def _meet(a, b, closed):
    (s, e), (u, v) = a, b
    if None in (s, e, u, v) or any(isinstance(x, float) and math.isnan(x) for x in (s, e, u, v)):
        return False
    points = s == e, u == v
    if e < s or v < u:
        return False
    if closed or all(points):
        return s <= v and u <= e
    if points[0]:
        return u <= s < v
    if points[1]:
        return s <= u < e
    return s < v and u < e


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("hot_rows", [20_000, 7])
@pytest.mark.parametrize("kind", ["int", "double"])
def test_intervals(spark, closed, hot_rows, kind):
    rnd = random.Random(3)

    def side(n):
        rows = []
        for i in range(n):
            s = rnd.choice([None, *([rnd.randint(-50, 400)] * 20)])
            size = rnd.choice([0, 1, 1, 2, 3, 3, 5, 9, 40, 300, -2])
            e = None if s is None or rnd.random() < 0.03 else s + size
            if kind == "double":
                s, e = (x if x is None else x / 3 for x in (s, e))
                if rnd.random() < 0.05:
                    s, e = rnd.choice([(float("-inf"), e), (s, float("inf")), (float("nan"), e), (float("-inf"), float("inf"))])
            rows.append((i, rnd.choice(["a", "a", "a", "b", None]), s, e))
        return rows

    left, right = side(160), side(130)
    # an empty half-open interval is not a point
    empty = lambda s, e: not closed and s is not None and s == e
    want = sorted((i, j) for i, k, s, e in left for j, q, u, v in right if k is not None and k == q and not empty(s, e) and not empty(u, v) and _meet((s, e), (u, v), closed))
    a = spark.createDataFrame(left, f"id long, k string, s {kind}, e {kind}")
    b = spark.createDataFrame(right, f"id long, k string, s {kind}, e {kind}").selectExpr("*", "1 AS bin", "2 AS level")
    got = interval_join(a, b, ("s", "e"), ("s", "e"), ["k"], closed, hot_rows=hot_rows)
    assert got.columns == ["id_x", "k", "s_x", "e_x", "id_y", "s_y", "e_y", "bin", "level"]
    assert sorted((r.id_x, r.id_y) for r in got.collect()) == want and len(want) > 100
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    lone = interval_join(a, b, ("s", "e"), ("s", "e"), ["k"], closed, "left", hot_rows=hot_rows).where("id_y IS NULL")
    assert sorted(r.id_x for r in lone.collect()) == sorted({r[0] for r in left} - {i for i, _ in want})


def test_points_in_intervals_and_points_on_points(spark):
    points = spark.createDataFrame([(i, float(i % 10)) for i in range(100)], "p long, x double")
    bands = spark.createDataFrame([("low", 0, 3), ("mid", 3, 7), ("none", 7, 7), ("back", 9, 2)], "band string, lo int, hi int")
    got = interval_join(points, bands, "x", ("lo", "hi"), closed=False, hot_rows=5).groupBy("band").count().collect()
    assert {(r.band, r["count"]) for r in got} == {("low", 30), ("mid", 40)}
    got = interval_join(points, points, "x", "x", closed=False, hot_rows=5)
    assert got.count() == 1000 and got.where("x_x <> x_y").count() == 0
    assert interval_join(points.limit(0), bands, "x", ("lo", "hi")).count() == 0
    assert interval_join(points, bands.where("lo IS NULL"), "x", ("lo", "hi"), how="left").count() == 100
    with pytest.raises(ValueError):
        interval_join(points, bands, "x", ("lo", "hi"), how="outer")


@pytest.mark.parametrize("kind", ["int", "double"])
def test_overlaps_are_counted_without_pairs(spark, kind):
    rnd = random.Random(5)

    def side(n):
        rows = []
        for i in range(n):
            s = rnd.choice([None, *([rnd.randint(-50, 400)] * 20)])
            e = None if s is None or rnd.random() < 0.03 else s + rnd.choice([0, 1, 1, 2, 3, 9, 40, 300, -2])
            if kind == "double":
                s, e = (x if x is None else x / 4 for x in (s, e))
            if kind == "double" and rnd.random() < 0.1:
                s, e = rnd.choice([(float("-inf"), e), (s, float("inf")), (float("nan"), e), (float("-inf"), float("inf"))])
            rows.append((i, rnd.choice(["a", "a", "a", "b", None]), s, e))
        return [*rows, rows[0]]

    left, right = side(160), side(130)
    a = spark.createDataFrame(left, f"id long, k string, s {kind}, e {kind}")
    b = spark.createDataFrame(right, f"at long, key string, s {kind}, e {kind}")
    for by in ((), [("k", "key")]):
        agree = lambda k, q: not by or (k is not None and k == q)
        want = sorted((i, sum(agree(k, q) and _meet((s, e), (u, v), True) for _, q, u, v in right)) for i, k, s, e in left)
        got = count_overlaps(a, b, ("s", "e"), ("s", "e"), by, slice_rows=20)
        assert got.columns == ["id", "k", "s", "e", "n"]
        assert sorted((r.id, r.n) for r in got.collect()) == want and max(n for _, n in want) > 10
    assert [r.n for r in count_overlaps(a.limit(2), b.limit(0), ("s", "e"), ("s", "e")).collect()] == [0, 0]
    assert count_overlaps(a.limit(0), b, ("s", "e"), ("s", "e")).count() == 0


def test_one_key_of_many_overlaps_is_counted(spark):
    """Each of 200,000 intervals meets all others: the 40 billion pairs are never made."""
    rows = spark.range(200_000).selectExpr("id", "id AS s", "id + 1000000 AS e")
    got = count_overlaps(rows, rows, ("s", "e"), ("s", "e"))
    assert got.where("n <> 200000").isEmpty() and got.count() == 200_000
