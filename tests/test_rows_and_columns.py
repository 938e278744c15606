import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablesmith import session, types
from tablesmith.operators import columns, fill, joins, ordering, rows, scale
from tablesmith.operators.analytics import aggregate, correlation, histogram, value_counts
from tablesmith.plans import registry


def values(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()]


def test_logical_types(spark):
    df = spark.sql("SELECT 1 AS i, 1.5D AS f, true AS b, DATE '2020-01-01' AS d, TIMESTAMP_NTZ '2020-01-01 00:00:00' AS t, 'x' AS s, array(1) AS a")
    assert types.column_types(df) == {
        "i": "integer", "f": "float", "b": "boolean", "d": "datetime", "t": "datetime", "s": "string", "a": "array<int>",
    }
    assert types.numeric_columns(df) == ["i", "f"]
    assert types.categorical_columns(df) == ["b", "s"]


def test_nan_is_missing(spark):
    df = types.nan_to_null(spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double"))
    assert df.where("v IS NULL").count() == 2


def test_not_equal_keeps_nulls(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    assert values(rows.filter_rows(df, "s", "!=", "a"), "s") == ["b", None]
    assert values(rows.filter_rows(df, "s", "==", "a"), "s") == ["a"]
    assert values(rows.filter_rows(df, "s", "not_contains", "A"), "s") == ["b", None]
    with pytest.raises(ValueError):
        rows.filter_rows(df, "s", "~", "a")
    with pytest.raises(ValueError):
        rows.filter_rows(df, "nope", "==", "a")


def test_contains_is_a_pattern_unless_literal(spark):
    df = spark.createDataFrame([("a.c",), ("abc",)], "s string")
    assert rows.filter_rows(df, "s", "contains", "A.C").count() == 2
    assert values(rows.filter_rows(df, "s", "contains", "A.C", literal=True), "s") == ["a.c"]


def test_sort_puts_nulls_last_both_ways(spark):
    df = spark.createDataFrame([(1, 2), (2, None), (3, 1)], "id int, v int")
    assert values(rows.sort_rows(df, "v", "asc"), "v") == [1, 2, None]
    assert values(rows.sort_rows(df, "v", "desc"), "v") == [2, 1, None]


def test_page_bounds(spark):
    df = spark.range(10).withColumnRenamed("id", "v")
    assert values(rows.page(df, 2, 4, sort_by="v"), "v") == [4, 5, 6, 7]
    with pytest.raises(ValueError):
        rows.page(df, 1, 501)
    assert rows.page_totals(df.limit(0)).first().asDict() == {"total": 0, "total_pages": 1}


def test_first_duplicate_is_kept(spark):
    df = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, None, "z"), (4, None, "w")], "id int, k string, v string")
    kept = rows.remove_duplicates(df, ["k"], row_id="id")
    assert sorted(values(kept, "id")) == [1, 2]
    assert kept.columns == df.columns
    assert rows.remove_duplicates(kept, ["k"], row_id="id").count() == 2


def test_samples(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    assert rows.sample_rows(df).count() == 1000
    assert sorted(values(rows.sample_rows(df, n=50), "k")) == sorted(values(rows.sample_rows(df.repartition(7), n=50), "k"))
    for bad in ({"n": 0}, {"frac": 0}, {"frac": 1.5}):
        with pytest.raises(ValueError):
            rows.sample_rows(df, **bad)


def test_find_update_delete(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, None, 3)], "id int, k string, v int")
    assert values(rows.find(df, {"k": None}), "id") == [3]
    assert values(rows.find(df, sort={"v": -1}, limit=1, projection=["id"]), "id") == [3]
    changed = rows.update_where(df, {"k": "a"}, {"k": "z", "v": 9})
    assert values(changed, "k", "v") == [("z", 9), ("b", 2), (None, 3)]
    assert values(rows.delete_where(df, {"k": "a"}), "id") == [2, 3]
    assert rows.delete_where(df, {}).count() == 0
    with pytest.raises(ValueError):
        rows.find(df, {"nope": 1})


def test_split_and_merge(spark):
    df = spark.createDataFrame([("a.b",), ("c",), (None,)], "s string")
    out = columns.split_column(df, "s", ".")
    assert out.columns == ["s", "s_1", "s_2"]
    assert values(out, "s_1", "s_2") == [("a", "b"), ("c", None), (None, None)]
    merged = columns.merge_columns(out, ["s_1", "s_2"], "+", "m")
    assert values(merged, "m") == ["a+b", "c", ""]
    assert columns.merge_columns(out, ["s_1"]).columns == out.columns


def test_formula_guard(spark):
    df = spark.createDataFrame([(2, 3)], "a int, b int")
    assert values(columns.formula_column(df, "a * b + 1", "c"), "c") == [7]
    for bad in ("", "__import__('os')", "lambda x: x", "reflect('java.lang.System', 'exit')", "(select 1)"):
        with pytest.raises(ValueError):
            columns.formula_column(df, bad, "c")


def test_casts_coerce(spark):
    df = spark.createDataFrame([("7",), ("3.0",), ("3.7",), ("5d",), (" 8 ",), ("x",), (None,)], "s string")
    assert values(columns.change_dtype(df, "int"), "s") == [7, 3, None, None, 8, None, None]
    assert values(columns.change_dtype(df, "float"), "s") == [7.0, 3.0, 3.7, None, 8.0, None, None]
    assert columns.change_dtype(df, "complex") is df
    flags = spark.createDataFrame([("Yes",), ("0",), ("maybe",)], "s string")
    assert values(columns.change_dtype(flags, "boolean"), "s") == [True, False, None]


def test_dates_month_first(spark):
    days = ["2023-01-15", "01/02/2023", "28/02/2023", "Jan 5, 2023", "5 January 2023", "20230106", "2023/1/7", "2023-01-15T10:20:30Z", "2023-02-30", "never", None]
    df = spark.createDataFrame([(d,) for d in days], "d string")
    got = [v and v.strftime("%Y-%m-%d %H:%M") for v in values(columns.change_dtype(df, "datetime"), "d")]
    assert got[:7] == [f"{d} 00:00" for d in ("2023-01-15", "2023-01-02", "2023-02-28", "2023-01-05", "2023-01-05", "2023-01-06", "2023-01-07")]
    assert got[7] == "2023-01-15 10:20"
    assert got[8:] == [None, None, None]


def test_label_codes(spark, monkeypatch):
    df = spark.createDataFrame([("b",), ("a",), ("c",), (None,), ("a",)], "s string")
    assert values(columns.label_encode(df), "s") == [1, 0, 2, -1, 0]
    monkeypatch.setattr(columns, "BROADCAST_ROWS", 1)  # the sorted, written numbering
    assert sorted(values(columns.label_encode(df), "s")) == [-1, 0, 0, 1, 2]


def test_one_hot_names_differ_in_case(spark):
    df = spark.createDataFrame([(1, "A"), (2, "a"), (3, None)], "id int, s string")
    out = columns.one_hot_encode(df)
    assert out.columns == ["id", "s_A", "s_a_2"]
    assert [(r.s_A, r.s_a_2) for r in out.orderBy("id").collect()] == [(True, False), (False, True), (False, False)]
    assert {tuple(r) for r in columns.one_hot_cells(df, "id").collect()} == {(1, "s", "A"), (2, "s", "a")}
    assert columns.one_hot_cells(df.select("id"), "id").count() == 0


def test_one_hot(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "id int, s string")
    out = columns.one_hot_encode(df)
    assert out.columns == ["id", "s_a", "s_b"]
    assert values(out, "s_a", "s_b") == [(False, True), (True, False), (False, False)]
    with pytest.raises(ValueError):
        columns.one_hot_encode(df, max_values=1)


def test_fill_modes(spark):
    df = spark.createDataFrame([("b", 1), ("a", None), (None, 4), ("a", 4), ("b", 1)], "s string, v int")
    assert values(fill.fill_missing(df, "mode"), "s", "v") == [("b", 1), ("a", 1), ("a", 4), ("a", 4), ("b", 1)]
    assert values(fill.fill_missing(df, "median"), "v") == [1.0, 2.5, 4.0, 4.0, 1.0]
    assert values(fill.fill_missing(df, "constant", value=0), "s", "v")[1:3] == [("a", 0), ("0", 4)]
    with pytest.raises(ValueError):
        fill.fill_missing(df, "ffill")


@pytest.mark.parametrize("slice_rows", [1_000, 7])
@pytest.mark.parametrize("backward", [False, True])
def test_fill_along_any_slicing(spark, slice_rows, backward):
    data = [(i, float(i) if i % 9 == 4 else None, None) for i in range(100)]
    df = spark.createDataFrame(data, "id bigint, v double, e double").repartition(5)
    got = {r.id: (r.v, r.e) for r in ordering.fill_along(df, ["v", "e"], "id", backward, slice_rows).collect()}
    known = [i for i in range(100) if i % 9 == 4]
    for i in range(100):
        near = [k for k in known if k >= i][:1] if backward else [k for k in known if k <= i][-1:]
        assert got[i] == (float(near[0]) if near else None, None)


def test_row_ids_are_dense_and_in_order(spark):
    df = spark.range(0, 1000, 1, 7).withColumnRenamed("id", "v")
    got = sorted(values(ordering.add_row_id(df), "row_id", "v"))
    assert got == [(i, i) for i in range(1000)]


def test_outliers_and_scaling_of_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (None, None)], "x double, y double")
    assert values(scale.normalize(df, "minmax"), "x", "y") == [(0.0, 0.0), (0.5, 0.0), (1.0, 0.0), (None, 0.0)]
    assert values(scale.normalize(df, "standard"), "y") == [0.0] * 4
    assert scale.remove_outliers(df, "zscore", threshold=1.0).count() == 2
    assert scale.remove_outliers(df, "iqr").count() == 4


def test_null_keys_match_in_joins(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, x int")
    right = spark.createDataFrame([(None, 3), ("b", 4)], "k string, x int")
    assert sorted(values(joins.join_datasets(left, right, "k", "k"), "k", "x_x", "x_y"), key=str) == [(None, 2, 3)]
    outer = joins.join_datasets(left, right, "k", "k", "outer")
    assert sorted(values(outer, "k", "x_x", "x_y"), key=str) == [("a", 1, None), ("b", None, 4), (None, 2, 3)]
    for bad in ({"how": "cross"}, {"suffixes": ("_a",)}, {"right_on": "nope"}):
        with pytest.raises(ValueError):
            joins.join_datasets(left, right, **({"left_on": "k", "right_on": "k"} | bad))


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 4, 4)], "v double")
    assert sorted(values(histogram(df, "v", 4), "bin_index", "bin", "n")) == [(0, 0.0, 1), (1, 1.0, 1), (2, 2.0, 1), (3, 3.0, 3)]
    flat = spark.createDataFrame([(7.0,), (7.0,)], "v double")
    assert sum(values(histogram(flat, "v", 2), "n")) == 2
    assert histogram(df.limit(0), "v").count() == 0
    with pytest.raises(ValueError):
        histogram(df, "v", 201)


def test_groups_drop_null_keys(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, 5)], "k string, v int")
    assert values(aggregate(df, "k", "v", "sum"), "name", "value") == [("a", 0)]
    assert values(value_counts(df, "k"), "name", "value") == [("a", 2)]
    with pytest.raises(ValueError):
        aggregate(df, "k", "v", "__class__")


def test_correlation_of_wide_tables(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 5))
    data = base[:, rng.integers(0, 5, 140)] * rng.normal(size=140) + rng.normal(size=(300, 140)) * rng.uniform(0, 2, 140) + 1e6
    data[:, 7] = 5.0
    data[rng.random(data.shape) < 0.2 * (np.arange(140) % 3 == 0)] = np.nan
    data[:, 9] = np.nan
    names = [f"c {i}" for i in range(140)]
    frame = pd.DataFrame(data, columns=names)
    df = spark.createDataFrame(frame).repartition(5)
    df = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in names])
    got = {(r.x, r.y): r.value for r in correlation(df, digits=None).collect()}
    assert len(got) == 140 * 140
    assert correlation(df.limit(0)).where("value IS NULL").count() == 140 * 140
    want = frame.corr()
    for a in range(140):
        for b in range(a, 140):
            value, expected = got[names[a], names[b]], want.iloc[a, b]
            known = not np.isnan(expected) and 7 not in (a, b)
            assert value == got[names[b], names[a]] and (value is not None) == known
            assert not known or abs(value - expected) < 1e-9


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], "x double, y double")
    got = {(r.x, r.y): r.value for r in correlation(df).collect()}
    assert got == {("x", "x"): 1.0, ("x", "y"): None, ("y", "x"): None, ("y", "y"): None}


def test_pipeline_registry(spark):
    assert len(registry.list_operations()) == 18
    with pytest.raises(ValueError):
        registry.apply_operation(spark.range(1), "nope")
    df = spark.createDataFrame([(" a ", 1), (" a ", 1), (None, None)], "s string, v int")
    keyed = spark.createDataFrame([(1, "LA", 9007199254740993), (2, "LA", 9007199254740993)], "id int, city string, big bigint")
    for own in (registry.auto_clean(keyed, "id"), rows.remove_duplicates(keyed, row_id="id")):
        assert {(r.id, r.big) for r in own.collect()} == {(1, 9007199254740993), (2, 9007199254740993)}
    assert rows.remove_duplicates(ordering.mark_row_id(keyed, "id"), row_id="id").count() == 1
    cleaned = registry.auto_clean(df)
    assert values(cleaned, "s", "v") == [("a", 1.0), ("a", 1.0)]


def test_empty_tables_pass_through(spark):
    df = spark.createDataFrame([], "id bigint, s string, v double")
    steps = {
        "remove_duplicates": {}, "drop_nulls": {}, "fill_missing": {"method": "median"}, "trim_spaces": {}, "change_case": {},
        "remove_outliers": {}, "normalize": {}, "label_encode": {}, "one_hot_encode": {}, "change_dtype": {"dtype": "string"},
        "split_column": {"column": "s"}, "sample_rows": {},
    }
    for name, params in steps.items():
        assert registry.apply_operation(df, name, params).count() == 0, name


def test_filters_reach_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = rows.filter_rows(orders, "o_totalprice", ">", 1000)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan
    bounded = scale.remove_outliers(orders, "iqr", ["o_totalprice"]).select("o_orderkey")
    for op, value, pushed in (
        ("==", 5, "EqualTo(o_custkey,5)"), (">", "5", "GreaterThan(o_custkey,5)"), (">", 5.5, "GreaterThan(o_custkey,5)"), (">=", 5.5, "GreaterThanOrEqual(o_custkey,6)"),
        ("<", 5.5, "LessThan(o_custkey,6)"), ("<=", 5.0, "LessThanOrEqual(o_custkey,5)"),
    ):
        kept = rows.filter_rows(orders, "o_custkey", op, value)
        assert pushed in kept._jdf.queryExecution().executedPlan().toString()
        python = {"==": lambda x: x == 5, ">": lambda x: x > float(value), ">=": lambda x: x >= value, "<": lambda x: x < value, "<=": lambda x: x <= value}[op]
        assert kept.count() == sum(python(r.o_custkey) for r in orders.select("o_custkey").collect())
    for method in ("iqr", "zscore"):
        whole = scale.remove_outliers(orders, method, ["o_custkey"])._jdf.queryExecution().executedPlan().toString()
        assert "LessThanOrEqual(o_custkey" in whole
    text = bounded._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in text or "LessThanOrEqual(o_totalprice" in text
    assert "o_orderpriority" not in text.split("ReadSchema")[-1]


def test_scratch_tables_go(spark):
    with session.scratch_tables(spark) as keep:
        table = keep(spark.range(3), "x")
        (path,) = {p.rsplit("/", 1)[0] for p in table.inputFiles()}
        assert table.count() == 3
    assert not spark._jvm.java.io.File(path.removeprefix("file://")).exists()
    with pytest.raises(ValueError):
        session.delete_path(spark, "/tmp/other")


def test_broadcasts_are_checked_in_bytes(spark):
    wide = spark.range(10).selectExpr("id", "repeat('x', 1000) AS t")
    hinted = lambda **k: "ResolvedHint" in session.broadcast_if_small(wide, **k)._jdf.queryExecution().analyzed().toString()
    assert hinted() and not hinted(limit=9) and not hinted(limit_bytes=9000)


def test_strings_from_functions(spark):
    df = spark.createDataFrame([("o'brien-smith 3rd",), ("  a\t",), (" a",), ("straße ßa",)], "s string")
    assert values(columns.change_case(df, "title"), "s")[0] == "O'Brien-Smith 3Rd"
    assert values(columns.change_case(df, "title"), "s")[3] == "Straße Ssa"
    assert values(columns.trim_spaces(df), "s")[1:3] == ["a", "a"]
