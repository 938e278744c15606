"""Files cut into tiny splits against readers that see them whole."""

import csv
import io
import json
import random

import pytest

from tablesmith.sources import readers, splits


@pytest.fixture
def tiny(spark):
    """Splits of a few dozen bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "37", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield spark
    for n, v in before.items():
        spark.conf.set(n, v)


def _tasks(spark, path, kind):
    return splits._pieces(spark, str(path), kind).select("file", "block").distinct().count()


def _cell(rnd):
    if rnd.random() < 0.15:
        return ""
    return "".join(rnd.choice(["a", "b", " ", "é", ",", ";", '"', '""', "\n", "\n\n", "\r\n", "x" * 9, '",', ',"', "\\"]) for _ in range(rnd.randint(1, 8)))


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_csv_fields_with_line_breaks(tiny, tmp_path, ends):
    rnd = random.Random(1)
    for k, name in enumerate(("a.csv", "b.csv")):
        rows = [[i + 1000 * k, _cell(rnd), _cell(rnd)] for i in range(60)]
        if k:
            rows[30][1] = "long\n" * 80  # over several splits
            rows[59][2] = 'last "one\n'
        out = io.StringIO()
        csv.writer(out, lineterminator=ends).writerows([["id", "one\ntwo", "v"], *rows])
        (tmp_path / name).write_bytes(out.getvalue().encode())
    want = sorted([int(r[0]), *[c if c not in readers.MISSING_TEXTS else None for c in r[1:]]] for n in ("a.csv", "b.csv") for r in list(csv.reader(io.StringIO((tmp_path / n).read_bytes().decode(), newline="")))[1:])
    got = readers.read_csv(tiny, str(tmp_path), multiline=True)
    assert got.columns == ["id", "one\ntwo", "v"] and got.schema["id"].dataType.simpleString() == "bigint"
    assert sorted([list(r) for r in got.collect()]) == want
    assert _tasks(tiny, tmp_path, splits.delimited(",")) > 20


def test_csv_odd_quotes_blank_lines_and_given_schema(tiny, tmp_path):
    (tmp_path / "x.csv").write_text('a;b\n\n1;say "hi\n2;"x\n\ny"\n\n3;"it ""is"""\n4;"un;closed\n')
    got = readers.read_delimited(tiny, str(tmp_path / "x.csv"), ";", multiline=True).collect()
    assert sorted(tuple(r) for r in got)[:3] == [(1, 'say "hi'), (2, "x\n\ny"), (3, 'it "is"')] and len(got) == 4
    given = readers.read_delimited(tiny, str(tmp_path / "x.csv"), ";", schema="n int, t string", multiline=True)
    assert given.columns == ["n", "t"] and given.where("n = 2").first().t == "x\n\ny"
    (tmp_path / "empty.csv").write_text("")
    assert readers.read_csv(tiny, str(tmp_path / "empty.csv"), multiline=True).columns == []
    (tmp_path / "head.csv").write_text("a,b\n")
    head = readers.read_csv(tiny, str(tmp_path / "head.csv"), multiline=True)
    assert head.columns == ["a", "b"] and head.count() == 0


def _value(rnd, depth=0):
    kind = rnd.randint(0, 6 if depth < 3 else 4)
    if kind < 3:
        return "".join(rnd.choice(["a", "{", "}", "[", "]", '"', "\\", "\n", ",", "é", "}{", '\\"}']) for _ in range(rnd.randint(0, 9)))
    if kind == 3:
        return rnd.randint(-5, 5)
    if kind == 4:
        return rnd.choice([True, None, 1.5])
    return [_value(rnd, depth + 1) for _ in range(rnd.randint(0, 3))] if kind == 5 else {rnd.choice("pq}"): _value(rnd, depth + 1) for _ in range(rnd.randint(0, 2))}


@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays(tiny, tmp_path, indent):
    rnd = random.Random(2)
    objects = [{"id": i, "text": _value(rnd, 3), "more": {"deep": [{"x": _value(rnd)}]}} for i in range(50)]
    objects[20]["text"] = "} { " * 100
    (tmp_path / "a.json").write_text(json.dumps(objects[:30], indent=indent, ensure_ascii=False))
    (tmp_path / "b.json").write_text(" \n" + json.dumps(objects[30:], indent=indent))
    found = splits.records(tiny, str(tmp_path), splits.json_array())
    got = sorted((json.loads(r.text) for r in found.collect()), key=lambda o: o["id"])
    assert got == objects
    assert _tasks(tiny, tmp_path, splits.json_array()) > 20


def test_json_reader_arrays_and_single_objects(tiny, tmp_path):
    rows = [{"id": i, "t": "a}b\nc", "o": {"k": i}} for i in range(20)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    got = readers.read_json(tiny, str(tmp_path / "a.json"))
    assert got.columns == ["id", "o.k", "t"] and sorted((r["id"], r["t"], r["o.k"]) for r in got.collect()) == [(i, "a}b\nc", i) for i in range(20)]
    (tmp_path / "empty.json").write_text("[]")
    assert readers.read_json(tiny, str(tmp_path / "empty.json")).columns == []
    (tmp_path / "one.json").write_text('{\n "a": 1\n}')
    assert [r.a for r in readers.read_json(tiny, str(tmp_path / "one.json"), lines=False).collect()] == [1]


def test_xml_rows(tiny, tmp_path):
    rnd = random.Random(3)
    want, parts = [], ["<?xml version='1.0'?>\n<rows>\n<!-- <row><id>-1</id></row> -->"]
    for i in range(40):
        text = "".join(rnd.choice(["a", "b c", "&lt;row&gt;", "é", "\n"]) for _ in range(rnd.randint(1, 9)))
        if i % 7 == 0:
            parts.append(f"<!-- {'<row>' * rnd.randint(0, 2)} {'</row>' * rnd.randint(0, 2)} -->")
        inner = "<![CDATA[</row><row>]]>" if i % 5 == 0 else text
        parts.append(f'<row kind="a>b{i}"\n><id>{i}</id><t>{inner}</t><rowid>7</rowid></row>')
        want.append((i, f"a>b{i}", "</row><row>" if i % 5 == 0 else text.replace("&lt;", "<").replace("&gt;", ">").strip()))
    parts.append('<row kind="e"/></rows>')
    (tmp_path / "a.xml").write_text("".join(parts))
    kinds = "_kind string, id int, t string, rowid int"
    got = readers.read_xml(tiny, str(tmp_path / "a.xml"), schema=kinds)
    rows = sorted(((r.id, r._kind, r.t.strip() if r.t else r.t) for r in got.collect()), key=lambda r: (r[0] is None, r[0]))
    whole = tiny.read.format("xml").option("rowTag", "row").schema(kinds).load(str(tmp_path / "a.xml")).collect()
    assert sorted(map(str, got.collect())) == sorted(map(str, whole))
    assert rows[:-1] == want and rows[-1] == (None, "e", None)
    assert _tasks(tiny, tmp_path, splits.xml_rows("row")) > 20
    (tmp_path / "none.xml").write_text("<rows></rows>")
    assert readers.read_xml(tiny, str(tmp_path / "none.xml"), schema="id int").count() == 0


def test_multiline_query_writes_a_file_for_each_partition(spark, tmp_path):
    """All rows of several files, by several tasks: none of them writes the whole table."""
    from catalog import sources

    rows = [(i, f'a, "{i}"\n\nb', "en", "src") for i in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[10 * k : 10 * k + 10], "doc_id long, text string, lang string, source string").coalesce(1).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    before = {n: spark.conf.get(n) for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = sources.src_csv_multiline(spark, str(tmp_path))
        files = got.inputFiles()
        found = sorted((r.doc_id, r.text, r.lang, r.source) for r in got.collect())
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert found == [(i, t.replace("\n", '\n"'), lang, "src,\n") for i, t, lang, _ in rows]
    assert len(files) > 1
