"""Profile, validation, SQL guard, sources, forecasts, models, vectors, intents."""

import pytest
from pyspark.sql import functions as F

from tablesmith.operators import forecast, ml, vectors
from tablesmith.plans import insights, intents, outliers, profile, report, sqlspace, validate
from tablesmith.sources import readers, tables, writers


def test_skewness_is_corrected(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (3.0,)], "v double")
    assert df.agg(insights.sample_skewness(F.col("v"))).first()[0] == pytest.approx(1.7636, abs=1e-4)


def test_outlier_report_of_constants_and_empties(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None), (1.0, None), (9.0, None)], "v double, e double")
    rows = outliers.outlier_report(df).collect()
    assert [r.column for r in rows] == ["v"]
    assert (rows[0].iqr_count, rows[0].zscore_count, rows[0].modified_zscore_count) == (1, 0, 0)
    assert outliers.outlier_report(df.limit(0)).count() == 0


def test_profiles_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id bigint, email string, v double")
    assert profile.profile_summary(df).first().asDict() == {"rows": 0, "columns": 3, "duplicate_rows": 0, "missing_cells": 0, "missing_pct": 0.0}
    assert {r.column: r.semantic_type for r in profile.semantic_types(df).collect()} == {"id": "empty", "email": "empty", "v": "empty"}
    assert profile.column_profile(df).count() == 3 and profile.column_stats(df).count() == 3
    assert profile.quality_scores(df).first().completeness == 100.0
    assert [r.rule for r in validate.validate(df).collect()] == ["clean"]
    assert validate.validate_dataset(df).count() == 0


def test_semantic_types_by_value(spark):
    cases = {
        "a": (["550e8400-e29b-41d4-a716-446655440000"], "uuid"),
        "b": (["12%", "3.5 %"], "percentage"),
        "c": (["$1,200.50", "€3"], "currency"),
        "d": (["10.0.0.1", "192.168.1.255"], "ipv4"),
        "e": (["yes", "no"], "boolean"),
        "f": (["1.5", "22"], "numeric"),
        "g": (["male", "F"], "gender"),
        "h": (["2023-01-01", "Jan 5, 2023"], "date"),
        "country": (["france", "Peru"], "country"),
        "us_state": (["Texas", "Ohio"], "state"),
        "zip": (["x"], "zip"),
        "note": (["hello there", "x"], "text"),
    }
    for name, (values, want) in cases.items():
        df = spark.createDataFrame([(v,) for v in values], f"`{name}` string")
        assert profile.semantic_types(df).first().semantic_type == want, name


def test_report_sections_fail_alone(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    parts = report.enterprise(df, row_id="nope")
    assert "fuzzy_duplicates" not in parts and "profile" in parts
    assert [r.section for r in parts["errors"].collect()] == ["fuzzy_duplicates"]
    near = spark.createDataFrame([(1, "aaaaaaaaaa", 1.0), (2, "aaaaaaaaab", 1.0), (3, "zzzz", 9.0)], "id int, s string, v double")
    whole = report.enterprise(near, row_id="id", fuzzy_columns=["s"])
    values = {r.metric: r.value for r in whole["summary"].collect()}
    assert (values["Fuzzy Duplicate Groups"], values["Potential Duplicates"]) == ("1", "1") and whole["errors"].count() == 0
    # a section that fails when it runs is named, and the others are there
    broken = near.withColumn("s", F.when(F.col("id") < 9, F.col("s")).otherwise(F.raise_error(F.lit("boom"))))
    broken = broken.withColumn("s", F.when(F.col("id") == 3, F.raise_error(F.lit("boom"))).otherwise(F.col("s")))
    parts = report.enterprise(broken, row_id="id")
    assert "fuzzy_duplicates" in {r.section for r in parts["errors"].collect()} and parts["errors"].columns == ["section", "kind", "message"]
    assert report.quality_score(df).first().quality_score == 100


def test_sql_guard(spark):
    df = spark.range(3).withColumnRenamed("id", "v")
    assert sqlspace.run_sql(df, "select sum(v) AS s from data;").first().s == 3
    assert sqlspace.query(df, "WITH a AS (SELECT * FROM dataset) SELECT * FROM a").count() == 3
    nested = "WITH a AS (SELECT v FROM data), b AS (WITH c AS (SELECT * FROM a) SELECT * FROM c) SELECT * FROM b WHERE v IN (SELECT v FROM a)"
    assert sqlspace.query(df, nested).count() == 3 and sqlspace.query(df, "SELECT * FROM range(2)").count() == 2
    spark.range(1).createOrReplaceTempView("foreign_view")
    spark.range(7).createOrReplaceTempView("data")
    reaching = (
        "select * from parquet.`/etc`", "SELECT * FROM `csv`.`/etc/passwd`", "SELECT * FROM csv /* x */ . /* y */ `/etc/passwd`", "SELECT * FROM foreign_view",
        "SELECT * FROM global_temp.x", "SELECT v FROM data WHERE v IN (SELECT id FROM foreign_view)", "SELECT (SELECT max(id) FROM foreign_view) FROM data",
        "SELECT 'CTE [foreign_view]' FROM foreign_view", "WITH a AS (SELECT * FROM `text`.`/etc/passwd`) SELECT * FROM a", "TABLE foreign_view",
    )
    for bad in (*reaching, "", "DELETE FROM data", "select 1; select 2", "SELECT 1 WHERE 'x' = 'drop'", "EXPLAIN SELECT 1", "select reflect('a','b')", "select `reflect`('a','b')"):
        with pytest.raises(sqlspace.SqlError):
            sqlspace.query(df, bad)
    with pytest.raises(sqlspace.SqlError):
        sqlspace.query(df, "SELECT nope FROM data")
    assert spark.table("data").count() == 7  # the session's own view is there again
    assert not spark.catalog.tableExists("dataset")
    assert sqlspace.run_sql(spark.range(6000), "select * from data", limit=None).count() == 6000
    with pytest.raises(ValueError):
        sqlspace.run_sql(df, "select * from data", limit=0)
    names = {"My Data (1)": "my_data_1", "2024 x": "ds_2024_x", "--": "ds_dataset", "a__b": "a_b"}
    assert {k: sqlspace.sanitize_table_name(k) for k in names} == names


def test_long_integers_keep_their_digits(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("a,b,c\n1234567890123456789,12345678901234567890,5\n1234567890123456788,1,\n")
    df = readers.load(spark, str(path))
    assert df.dtypes == [("a", "bigint"), ("b", "string"), ("c", "bigint")]
    assert {(r.a, r.b) for r in df.collect()} == {(1234567890123456789, "12345678901234567890"), (1234567890123456788, "1")}


def test_insights_look_at_every_column(spark):
    wide = spark.range(60).selectExpr(*[f"IF(id = 59, 1000000, id % 7 + {i}) AS n{i:02}" for i in range(20)], *[f"'one' AS c{i:02}" for i in range(20)])
    assert insights.skewed_columns(wide).count() == 20 and insights.skewed_columns(wide, ["n03"]).count() == 1
    assert insights.category_findings(wide).count() == 20
    spread = spark.range(100).selectExpr(*[f"IF(id > 95, 100000, id) AS n{i:02}" for i in range(15)])
    assert insights.outlier_density(spread).count() == 15


def test_readers(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,name,day,score,ok,gap\n1,"a, b",2023-01-15,1.5,True,NA\n2,"say ""x""",,2,FALSE,\n')
    df = readers.load(spark, str(path))
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("day", "string"), ("score", "double"), ("ok", "boolean"), ("gap", "string")]
    assert [tuple(r) for r in df.collect()] == [(1, "a, b", "2023-01-15", 1.5, True, None), (2, 'say "x"', None, 2.0, False, None)]
    (tmp_path / "t.txt").write_text("a|b\n1|2\n3|4\n")
    assert readers.load(spark, str(tmp_path / "t.txt")).columns == ["a", "b"]
    (tmp_path / "t.json").write_text('[{"a": {"b": 1, "c": {"d": "x"}}}, {"a": {"b": 2}}]')
    assert readers.load(spark, str(tmp_path / "t.json")).columns == ["a.b", "a.c.d"]
    (tmp_path / "empty.csv").write_text("a,b\n")
    for bad in ("t.exe", "empty.csv"):
        with pytest.raises(ValueError):
            readers.load(spark, str(tmp_path / bad))
    (tmp_path / "t.xml").write_text("<rows><row><a>1</a><b>x</b></row><row><a>2</a></row></rows>")
    assert readers.load(spark, str(tmp_path / "t.xml")).count() == 2


def test_jdbc_options():
    assert readers.jdbc_options("jdbc:x", query="SELECT 1")["query"] == "SELECT 1"
    got = readers.jdbc_options("jdbc:x", query="SELECT 1", partition_column="k", bounds=(0, 9), partitions=3)
    assert got["dbtable"] == "(SELECT 1) t" and got["numPartitions"] == "3" and "query" not in got
    for bad in ({}, {"table": "a", "query": "b"}, {"table": "a", "partition_column": "k"}):
        with pytest.raises(ValueError):
            readers.jdbc_options("jdbc:x", **bad)


def test_catalog_and_append(spark):
    spark.range(4).createOrReplaceTempView("four_rows")
    found = {r.table: r.row_count for r in tables.discover_catalog(spark).collect()}
    assert found["four_rows"] == 4
    a = spark.createDataFrame([("1", "x")], "id string, a string")
    b = spark.createDataFrame([("y",)], "b string")
    rows = writers.append_rows(a, b, id_column="id").collect()
    assert len(rows) == 2 and all(r.id for r in rows)


def test_forecasts(spark):
    df = spark.createDataFrame([("2023-01-01", 1.0), ("2023-01-03", 3.0), ("2023-01-03", 2.0), ("x", 9.0)], "day_date string, v double")
    series = forecast.daily_series(df, "day_date", "v")
    assert [r.value for r in series.orderBy("date").collect()] == [1.0, 0.0, 5.0]
    assert forecast.infer_date_column(df) == "day_date"
    ahead = forecast.linear(series, 2).orderBy("date").collect()
    assert [round(r.value, 9) for r in ahead] == [6.0, 8.0] and str(ahead[0].date) == "2023-01-04"
    assert [r.value for r in forecast.moving_average(series, 2).collect()] == [2.0, 2.0]
    assert [r.value for r in forecast.seasonal_naive(series, 5).orderBy("date").collect()] == [1.0, 0.0, 5.0, 1.0, 0.0]
    falling = forecast.daily_series(spark.createDataFrame([("2023-01-01", 5.0), ("2023-01-02", 1.0)], "d string, v double"), "d", "v")
    assert [r.value for r in forecast.linear(falling, 2).collect()] == [0.0, 0.0]
    for bad in ({"horizon": 0}, {"method": "magic"}, {"date_column": "nope"}):
        with pytest.raises(ValueError):
            forecast.forecast(df, target="v", **bad)
    with pytest.raises(ValueError):
        forecast.forecast(df.limit(1), "day_date")


def test_models_are_saved_and_applied(spark, tmp_path):
    rows = [(i, float(i % 17), "a" if i % 3 else None, 3.0 * (i % 17) + (1 if i % 3 else 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, x double, k string, y double")
    assert ml.infer_task(df, "y") == "regression" and ml.infer_task(df, "k") == "classification"
    trained = ml.train(df, "y", "id", model_type="linear_regression", test_size=0.25)
    assert trained.metrics.first().r2 > 0.99 and trained.rows_used == 200
    folder = ml.ModelFolder(spark, str(tmp_path))
    folder.save(trained)
    again = folder.load(trained.model_id)
    new = spark.createDataFrame([(1, 2.0, "never seen"), (2, None, None)], "id bigint, x double, k string")
    assert ml.predict(again, new).orderBy("id").collect() == ml.predict(trained, new).orderBy("id").collect()
    assert [r.model_id for r in folder.list().collect()] == [trained.model_id]
    assert folder.delete(trained.model_id)
    with pytest.raises(ValueError):
        ml.predict(trained, new.drop("x"))
    labelled = df.withColumn("c", F.when(F.col("x") > 8, "high").otherwise("low"))
    classes = ml.train(labelled, "c", "id", ["x"], model_type="logistic_regression")
    assert classes.metrics.first().accuracy > 0.9
    assert {r.prediction for r in ml.predict(classes, labelled).collect()} == {"high", "low"}
    for bad in ({"task": "magic"}, {"model_type": "magic"}, {"model_type": "logistic_regression"}, {"features": ["nope"]}):
        with pytest.raises(ValueError):
            ml.train(df, "y", "id", **bad)
    with pytest.raises(ValueError):
        ml.train(df.limit(4), "y", "id")


def test_split_is_exact_and_repeatable(spark):
    df = spark.range(1000).withColumn("c", F.when(F.col("id") < 900, "big").otherwise("small"))
    split = ml.train_test_split(df, "id", 0.2, stratify="c")
    counts = {r.c: r.n for r in split.where("is_test").groupBy("c").agg(F.count("*").alias("n")).collect()}
    assert counts == {"big": 180, "small": 20}
    again = ml.train_test_split(df.repartition(9), "id", 0.2, stratify="c")
    assert sorted(r.id for r in again.where("is_test").collect()) == sorted(r.id for r in split.where("is_test").collect())


def test_clusters(spark):
    rows = [(i, 0.0 + i % 3, 0.0) for i in range(30)] + [(i + 30, 100.0 + i % 3, 50.0) for i in range(30)] + [(99, None, 1.0)]
    got = ml.cluster(spark.createDataFrame(rows, "id bigint, x double, y double"), ["x", "y"], n_clusters=2, n_init=2)
    assert sorted(r["size"] for r in got.sizes.collect()) == [30, 30]
    assert sorted(round(r["mean"], 6) for r in got.centers.where("feature = 'x'").collect()) == [1.0, 101.0]
    assert got.data.where("cluster IS NULL").count() == 1
    summary = got.summary.first()
    assert summary.rows_used == 60 and summary.silhouette > 0.9
    with pytest.raises(ValueError):
        ml.cluster(got.data, ["x"], n_clusters=1)


def test_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0], "a"), (2, [1.0, 1.0], "b"), (3, [0.0], "a"), (4, None, "a")], "id int, v array<float>, kind string")
    got = vectors.vector_search(df, [0.0, 0.0], "id", "v", top_k=5)
    assert [(r.id, r.distance) for r in got.collect()] == [(1, 1.0), (2, 2.0)]
    assert [r.id for r in vectors.vector_search(df, [0.0, 0.0], "id", "v", where={"kind": "b"}).collect()] == [2]
    plan = vectors.vector_search_batch(df, {7: [0.0, 0.0]}, "id", "v")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Join" not in plan
    for bad in ([], None):
        with pytest.raises(ValueError):
            vectors.vector_search(df, bad, "id", "v")
    rows = spark.createDataFrame([(None, [1.0], {"a": 1}, None, "t")], "id string, embedding array<double>, m map<string,int>, n string, document string")
    out = vectors.normalize_metadata(rows).first()
    assert out.id and out.metadata == {"m": '{"a":1}'}


def test_intents(spark):
    says = {
        "Please deduplicate": "remove_duplicates", "drop nulls": "drop_nulls", "fill the missing": "auto_fill", "anomalies?": "remove_outliers",
        "correlate": "correlation", "overview": "profile", "top city": "value_counts", "distribution": "histogram", "hi": "help",
    }
    messages = spark.createDataFrame([(m,) for m in says], "m string")
    schema = spark.createDataFrame([], "city string, age int")
    got = {r.m: (r.action, r.params) for r in intents.route_intents(messages, "m", schema).collect()}
    assert {m: a for m, (a, _) in got.items()} == says
    assert got["top city"][1] == {"column": "city"} and got["distribution"][1] == {"column": "age"} and got["drop nulls"][1] == {"how": "any"}
    bare = spark.createDataFrame([], "when date")
    assert intents.route_intents(messages.where("m = 'distribution'"), "m", bare).first().action == "help"
