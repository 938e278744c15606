"""Audited cleaning: value rules, records, guards, plan shape."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from tablesmith.functions import text
from tablesmith.operators.ordering import mark_row_id
from tablesmith.plans import audit, smart
from tablesmith.plans.audit import Audited
from tablesmith.streaming import clean


def run(spark, step, column, values, kind="string", **params):
    df = spark.createDataFrame(list(enumerate(values)), f"row_id int, `{column}` {kind}")
    t = step(Audited.start(df, "row_id"), **params)
    data = {r.row_id: r[column] for r in t.data.collect()}
    log = {r.row_id: (r.method, r.confidence) for r in t.audit.collect()}
    return [data[i] for i in range(len(values))], log


def test_sentinels(spark):
    got, log = run(spark, smart.normalize_sentinels, "s", ["x", " N/A ", "", "___", "0", None, "Unknown", "(blank)"])
    assert got == ["x", None, None, None, "0", None, None, None]
    assert log == {i: ("sentinel_detection", 1.0) for i in (1, 2, 3, 6, 7)}


def test_text_is_tidied(spark):
    raw = ["a  b", "a\tb\nc", "  x ", "ﬁne", "zero​width", "ctrl\x07bell\r\n", "  pad  ", "ok", None, "a" + " " * 33 + "b", "é́"]
    got, log = run(spark, smart.clean_text, "s", raw)

    def want(s):
        s = unicodedata.normalize("NFKC", s)
        return " ".join("".join(c for c in s if c in "\n\t" or unicodedata.category(c)[0] != "C").split())

    assert got == [v if v is None else want(v) for v in raw]
    assert set(log) == {i for i, v in enumerate(raw) if v is not None and want(v) != v}


def test_names(spark):
    got, log = run(spark, smart.standardize_names, "full_name", ["ada LOVELACE", "o'brien-smith 3rd", "12345", "x", "Ada", " bob ", None, "élan vital"])
    assert got == ["Ada Lovelace", "O'Brien-Smith 3rd", "12345", "x", "Ada", "Bob", None, "élan Vital"]
    assert set(log) == {0, 1, 5, 7}


def test_categories(spark):
    got, _ = run(spark, smart.standardize_categories, "gender", ["M", " woman ", "n/a", "Male", "???", None])
    assert got == ["Male", "Female", "n/a", "Male", "???", None]
    got, _ = run(spark, smart.standardize_categories, "birth_country", ["u.s.", "Bharat", "england", "Peru"])
    assert got == ["United States", "India", "United Kingdom", "Peru"]


def test_emails(spark):
    raw = ["a@b.co", " a@b.co ", "a b@c.org", "a@@b.com", "a@b", "nope", "", None, "a@b@c"]
    got, log = run(spark, smart.repair_emails, "email", raw)
    assert got == ["a@b.co", " a@b.co ", "ab@c.org", "a@.b.com", "a@b.com", "nope", "", None, "a@b.c"]
    assert log == {2: ("email_repair", 0.85), 3: ("email_repair", 0.85), 4: ("email_repair", 0.85), 5: ("invalid_email_flag", 0.0), 8: ("email_repair", 0.85)}


def test_phones(spark):
    raw = ["+1 (555) 010-1234", "555.123.4567", "5551234", "12345", "44 20 7946 0958", "abc", "555-123-4567", "12345678", None, " "]
    got, log = run(spark, smart.standardize_phones, "phone", raw)
    assert got == ["+1-555-010-1234", "555-123-4567", "555-1234", "12345", "+44-207-946-0958", "abc", "555-123-4567", "12345678", None, " "]
    assert {i for i, m in log.items() if m[0] == "invalid_phone_flag"} == {3, 5}
    assert 6 not in log and 7 not in log


def test_addresses(spark):
    raw = ["12 main st, springfield, ca", "4  oak ave", "PO Box 7", "9 elm Rd. apt #b", "1 Ct", "st.x road", "5 Oak Street"]
    got, log = run(spark, smart.standardize_addresses, "address", raw)
    assert got == ["12 Main Street, Springfield, CA", "4 Oak Avenue", "PO Box 7", "9 Elm Road. Apt #B", "1 Court", "St.x Road", "5 Oak Street"]
    assert set(log) == {0, 1, 3, 4, 5}


def test_urls(spark):
    got, log = run(spark, smart.standardize_urls, "homepage", ["www.a.b", "a.b/c", "ftp://x", "no dots", "has space.com x", None])
    assert got == ["https://www.a.b", "https://a.b/c", "ftp://x", "no dots", "has space.com x", None]
    assert log == {0: ("url_standardization", 0.95), 1: ("url_standardization", 0.90)}


def test_dates(spark):
    got, log = run(spark, smart.standardize_dates, "signup", ["2023-01-15", "01/02/2023", "Jan 5, 2023", "never", None])
    assert got == ["2023-01-15", "2023-01-02", "2023-01-05", "never", None]
    assert set(log) == {1, 2}


def test_conversion_needs_nine_tenths(spark):
    got, log = run(spark, smart.convert_data_types, "v", ["1"] * 9 + ["$2,000"])
    assert got == [1.0] * 9 + [2000.0] and len(log) == 10
    got, _ = run(spark, smart.convert_data_types, "v", ["1"] * 8 + ["$2", "$3"])
    assert got[0] == "1"
    got, _ = run(spark, smart.convert_data_types, "v", ["$1", "$2"], strip_symbols_first=True)
    assert got == [1.0, 2.0]


def test_imputation_strategies(spark):
    values = [1.0, 2.0, None, 2.0, 10.0]
    for strategy, want, confidence in (("mean", 3.75, 0.85), ("median", 2.0, 0.9), ("mode", 2.0, 0.75)):
        got, log = run(spark, smart.impute_missing, "v", values, "double", numeric_strategy=strategy)
        assert got[2] == want and log == {2: (f"{strategy}_imputation", confidence)}


def test_duplicate_guard(spark):
    rows = [(i, i // 2 if i < 2 else i) for i in range(40)]  # one copy in 40
    df = spark.createDataFrame(rows, "row_id int, v int")
    t = Audited.start(mark_row_id(df, "row_id"), "row_id")
    own = smart.remove_exact_duplicates(Audited.start(df, "row_id"))  # the key is data: no row repeats
    assert not own.halted and own.data.count() == 40 and own.audit.count() == 0
    kept = smart.remove_exact_duplicates(t)
    assert not kept.halted and kept.data.count() == 39
    assert [(r.row_id, r.method) for r in kept.audit.collect()] == [(1, "exact_duplicate_removal")]
    halted = smart.remove_exact_duplicates(t, max_deletion_pct=1.0)
    assert halted.halted and "2.5%" in halted.halt_reason and halted.data.count() == 40


SAMPLE = [
    (1, "John Doe", "john@x.com", 30, "NYC", 100, "2023-01-15"),
    (2, "jane roe", " jane@x.com ", None, "LA", 120, "02/03/2023"),
    (3, "BOB", "bob@@x", 41, "unknown", -5, None),
    (4, "Ann Lee", "bad", 35, "NYC", 110, "never"),
]


def test_pipeline_records_equal_changes(spark):
    df = spark.createDataFrame(SAMPLE, "id int, name string, email string, age int, city string, salary int, signup_date string")
    result = smart.smart_clean(df, "id")
    data = {r.id: r for r in result.data.collect()}
    assert [data[i].name for i in (1, 2, 3, 4)] == ["John Doe", "Jane Roe", "Bob", "Ann Lee"]
    assert data[2].email == "jane@x.com" and data[3].email == "bob@@x"
    assert data[2].age == 35.0 and data[3].city == "NYC" and data[2].signup_date == "2023-02-03"
    log = result.audit.collect()
    summary = result.summary.first()
    assert summary.cells_changed == sum(r.old_value != r.new_value for r in log)
    assert (summary.rows_before, summary.rows_after, summary.halted) == (4, 4, False)
    by_method = {r.method: r.n for r in audit.audit_by_method(result.audit).collect()}
    assert by_method["sentinel_detection"] == 1 and by_method["invalid_email_flag"] == 2
    # recomputing instead of storing gives the same
    again = smart.smart_clean(df, "id", materialize=False)
    assert sorted(again.audit.collect(), key=str) == sorted(log, key=str)
    dry = smart.smart_clean(df, "id", dry_run=True)
    assert sorted(dry.data.collect(), key=str) == sorted(df.collect(), key=str)
    with pytest.raises(ValueError):
        smart.smart_clean(df, "id", steps=["nope"])


def test_pipeline_on_selected_steps_and_columns(spark):
    df = spark.createDataFrame(SAMPLE, "id int, name string, email string, age int, city string, salary int, signup_date string")
    result = smart.smart_clean(df, "id", steps=["standardize_names", "clean_text"], columns=["name"])
    assert {r.column for r in result.audit.collect()} == {"name"}


def test_halt_keeps_rows_and_skips_removal(spark):
    df = spark.createDataFrame([(i, "same", None) for i in range(10)] + [(10, None, None)], "id int, s string, t string")
    result = smart.smart_clean(mark_row_id(df, "id"), "id")
    assert result.halted and result.data.count() == 11


def test_row_local_steps_stay_in_the_jvm(spark):
    df = spark.createDataFrame(SAMPLE, "id int, name string, email string, age int, city string, salary int, signup_date string")
    steps = [s for s in smart.ROW_LOCAL if s != "clean_text"]
    for frame in (smart.smart_clean(df, "id", steps=steps).data, smart.smart_clean(df, "id", steps=steps).audit):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan.replace("PythonRDD", "") and "Exchange" not in plan
    assert "ArrowEvalPython" in smart.smart_clean(df, "id", steps=["clean_text"]).data._jdf.queryExecution().executedPlan().toString()


def test_signature_and_edges(spark):
    df = spark.createDataFrame([("Ab 1\t-x",), (" y",)], "s string")
    got = df.select(text.pattern_signature(F.col("s")).alias("p"), text.has_edge_space(F.col("s")).alias("e")).collect()
    assert [(r.p, r.e) for r in got] == [("AA 9 -A", False), (" A", True)]


def test_streams_take_row_local_work_only(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame(SAMPLE, "id int, name string, email string, age int, city string, salary int, signup_date string").write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    cleaned = clean.audited_stream(clean.clean_stream(stream, [("filter_rows", {"column": "salary", "op": ">", "value": 0})]), "id")
    query = clean.append_parquet(cleaned.data, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    got = {r.id: r.name for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "John Doe", 2: "Jane Roe", 4: "Ann Lee"}
    for bad in ([("normalize", {})],):
        with pytest.raises(ValueError):
            clean.clean_stream(stream, bad)
    with pytest.raises(ValueError):
        clean.audited_stream(stream, "id", ["impute_missing"])


def test_copies_of_one_file_are_dealt_out_before_they_are_combined(spark, monkeypatch):
    sizes = []

    def dealt(df, *keys, deal=smart.spread):
        out = deal(df, *keys)
        sizes.extend(n for n in out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())
        return out

    monkeypatch.setattr(smart, "spread", dealt)
    one_file = spark.range(4000).coalesce(1).selectExpr("id % 3900 AS a", "'x' AS b")
    t = smart.remove_exact_duplicates(smart.Audited.start(smart.add_row_id(one_file), "row_id"))
    assert t.data.count() == 3900 and t.audit.count() == 100
    assert sorted(r.row_id for r in t.audit.collect()) == list(range(3900, 4000))
    assert sum(sizes) == 4000 and max(sizes) < 4000 / 2
