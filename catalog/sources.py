"""Round trips through every format, schema discovery, appending."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.tables import table
from tablesmith.session import scratch_path
from tablesmith.sources import readers, tables, writers

_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders"
_WITH_GAPS = "SELECT row_id, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM null_orders"


def _orders(spark, sf, name="orders"):
    return table(spark, sf, name).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


def _delimited(spark, sf, sep, name):
    path = scratch_path(spark, name)
    _orders(spark, sf, "null_orders").write.option("sep", sep).option("header", True).csv(path)
    return path


@query("src_csv", _WITH_GAPS)
def src_csv(spark, sf):
    return readers.read_csv(spark, _delimited(spark, sf, ",", "csv"))


@query("src_csv_long_ids", "SELECT CAST(o_orderkey AS BIGINT) + 1234567890123000000 AS long_id, '9' || CAST(CAST(o_orderkey AS BIGINT) + 1234567890123000000 AS VARCHAR) AS longer_id FROM orders")
def src_csv_long_ids(spark, sf):
    """Integers of 19 digits stay integers; longer ones stay text."""
    path = scratch_path(spark, "long-ids")
    ids = table(spark, sf, "orders").selectExpr("CAST(o_orderkey AS BIGINT) + 1234567890123000000 AS long_id")
    ids.selectExpr("long_id", "concat('9', CAST(long_id AS STRING)) AS longer_id").write.option("header", True).csv(path)
    return readers.read_csv(spark, path)


@query("src_csv_multiline", "SELECT doc_id, replace(text, chr(10), chr(10) || '\"') AS text, lang, source || ',' || chr(10) AS source FROM documents")
def src_csv_multiline(spark, sf):
    """Line breaks, quotes and commas inside quotes, read in splits."""
    path = scratch_path(spark, "multiline")
    documents = table(spark, sf, "documents").selectExpr("doc_id", "replace(text, chr(10), concat(chr(10), '\"')) AS text", "lang", "concat(source, ',', chr(10)) AS source")
    documents.write.options(header=True, escape="\"", quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return readers.read_csv(spark, path, multiline=True)


@query("src_json_array", "SELECT conv_id, turn, text || '\"}],' AS text, turn + 1 AS \"at.next\" FROM conversations")
def src_json_array(spark, sf):
    """One array on one line for each file, with brackets and quotes inside texts."""
    path = scratch_path(spark, "array")
    rows = table(spark, sf, "conversations").selectExpr("to_json(named_struct('conv_id', conv_id, 'turn', turn, 'text', concat(text, '\"}],'), 'at', named_struct('next', turn + 1))) AS value")

    def bracketed(batches):
        import pyarrow as pa

        before = "["
        for batch in batches:
            for value in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([before + value])], names=["value"])
                before = ","
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if before == "[" else "]"])], names=["value"])

    rows.mapInArrow(bracketed, "value string").write.option("lineSep", " ").text(path)
    return readers.read_json(spark, path)


@query("src_tsv", _WITH_GAPS)
def src_tsv(spark, sf):
    return readers.read_tsv(spark, _delimited(spark, sf, "\t", "tsv"))


@query("src_psv", _WITH_GAPS)
def src_psv(spark, sf):
    return readers.read_psv(spark, _delimited(spark, sf, "|", "psv"))


@query("src_sniff", _WITH_GAPS)
def src_sniff(spark, sf):
    return readers.read_sniffed(spark, _delimited(spark, sf, ";", "sniff"))


@query("src_json", "SELECT event_id, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS \"props.k\" FROM events")
def src_json(spark, sf):
    path = scratch_path(spark, "json")
    nested = F.from_json("props", "k bigint").alias("props")
    table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", nested).write.json(path)
    return readers.read_json(spark, path)


@query("src_xml", _ORDERS)
def src_xml(spark, sf):
    path = scratch_path(spark, "xml")
    _orders(spark, sf).write.format("xml").option("rowTag", "order").option("rootTag", "orders").save(path)
    kinds = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string"
    return readers.read_xml(spark, path, row_tag="order", schema=kinds)


@query("src_parquet", "SELECT * FROM lineitem")
def src_parquet(spark, sf):
    return readers.load(spark, f"{sf.rstrip('/')}/lineitem.parquet")


@query("src_orc", _ORDERS)
def src_orc(spark, sf):
    path = scratch_path(spark, "orc")
    _orders(spark, sf).write.orc(path)
    return readers.read_orc(spark, path)


@query("sink_csv", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def sink_csv(spark, sf):
    path = scratch_path(spark, "sink-csv")
    writers.write_csv(table(spark, sf, "documents"), path)
    return readers.read_csv(spark, path, schema="doc_id bigint, text string, lang string, source string, n_chars bigint", multiline=True)


@query("sink_json", _WITH_GAPS)
def sink_json(spark, sf):
    path = scratch_path(spark, "sink-json")
    writers.write_json(_orders(spark, sf, "null_orders"), path)
    return readers.read_json(spark, path)


@query("sink_parquet", "SELECT * FROM null_orders")
def sink_parquet(spark, sf):
    path = scratch_path(spark, "sink-parquet")
    writers.write_parquet(table(spark, sf, "null_orders"), path)
    return readers.read_parquet(spark, path)


@query("append_rows", "SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier")
def append_rows(spark, sf):
    customers = table(spark, sf, "customer").selectExpr("c_custkey AS key", "c_name AS name", "c_mktsegment AS segment")
    suppliers = table(spark, sf, "supplier").selectExpr("s_suppkey AS key", "s_name AS name", "s_acctbal AS balance")
    return writers.append_rows(customers, suppliers)


@query("append_in_place", "SELECT l_orderkey, l_linenumber FROM lineitem UNION ALL SELECT o_orderkey, 0 FROM orders")
def append_in_place(spark, sf):
    path = scratch_path(spark, "append")
    writers.write_parquet(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), path)
    writers.append_to(table(spark, sf, "orders").selectExpr("o_orderkey AS l_orderkey", "0 AS l_linenumber"), path)
    return readers.read_parquet(spark, path)


_DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


@query("schema_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", (SELECT count(*) FROM {t}) AS row_count, count(*) AS columns FROM information_schema.columns WHERE table_name = '{t}'" for t in _DRIVER_TABLES))
def schema_row_counts(spark, sf):
    found = tables.discover_schema({t: table(spark, sf, t) for t in _DRIVER_TABLES})
    return found.groupBy("table", "row_count").agg(F.count(F.lit(1)).alias("columns"))


@query("dataset_meta", 'SELECT count(*) AS "rows", CAST(11 AS BIGINT) AS columns FROM lineitem')
def dataset_meta(spark, sf):
    return tables.dataset_meta(table(spark, sf, "lineitem"))
