"""Column operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import query
from catalog.tables import table
from tablesmith.operators import columns


@query("rename_column", "SELECT c_custkey, c_name AS customer_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def rename_column(spark, sf):
    return columns.rename_column(table(spark, sf, "customer"), "c_name", "customer_name")


@query("split_column", "SELECT *, split_part(p_name, ' ', 1) AS p_name_1, CASE WHEN len(string_split(p_name, ' ')) >= 2 THEN split_part(p_name, ' ', 2) END AS p_name_2 FROM part")
def split_column(spark, sf):
    return columns.split_column(table(spark, sf, "part"), "p_name", " ")


@query("merge_columns", "SELECT *, concat_ws(' | ', CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderpriority) AS label FROM null_orders")
def merge_columns(spark, sf):
    return columns.merge_columns(
        table(spark, sf, "null_orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"], " | ", "label"
    )


@query("drop_columns", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_shipdate FROM lineitem")
def drop_columns(spark, sf):
    return columns.drop_columns(table(spark, sf, "lineitem"), ["l_linestatus", "not_there"])


@query("formula_column", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem")
def formula_column(spark, sf):
    out = columns.formula_column(table(spark, sf, "lineitem"), "l_extendedprice * (1 - l_discount)", "revenue")
    return out.select("l_orderkey", "l_linenumber", "revenue")


@query("cast_string", "SELECT row_id, CAST(age AS VARCHAR) AS age, score_text FROM dirty_customer")
def cast_string(spark, sf):
    return columns.change_dtype(table(spark, sf, "dirty_customer").select("row_id", "age", "score_text"), "string", ["age", "score_text"])


@query("cast_int", "SELECT row_id, TRY_CAST(score_text AS BIGINT) AS score_text, CASE WHEN salary = floor(salary) THEN CAST(salary AS BIGINT) END AS salary, CAST(age AS BIGINT) AS age FROM dirty_customer")
def cast_int(spark, sf):
    view = table(spark, sf, "dirty_customer").select("row_id", "score_text", "salary", "age")
    return columns.change_dtype(view, "int", ["score_text", "salary", "age"])


@query("cast_float", "SELECT row_id, TRY_CAST(score_text AS DOUBLE) AS score_text, CAST(age AS DOUBLE) AS age, TRY_CAST(phone AS DOUBLE) AS phone FROM dirty_customer")
def cast_float(spark, sf):
    view = table(spark, sf, "dirty_customer").select("row_id", "score_text", "age", "phone")
    return columns.change_dtype(view, "float", ["score_text", "age", "phone"])


@query("cast_datetime", "SELECT row_id, coalesce(try_strptime(signup_date, '%Y-%m-%d'), try_strptime(signup_date, '%m/%d/%Y')) AS signup_date FROM dirty_customer")
def cast_datetime(spark, sf):
    return columns.change_dtype(table(spark, sf, "dirty_customer").select("row_id", "signup_date"), "datetime", ["signup_date"])


@query("cast_boolean", "SELECT doc_id, quality = 1 AS quality, toxic = 1 AS toxic FROM labels")
def cast_boolean(spark, sf):
    return columns.change_dtype(table(spark, sf, "labels"), "boolean", ["quality", "toxic"])


@query("remove_special", r"SELECT row_id, regexp_replace(email, '[^A-Za-z0-9\s]', '', 'g') AS email, regexp_replace(phone, '[^A-Za-z0-9\s]', '', 'g') AS phone FROM dirty_customer")
def remove_special(spark, sf):
    return columns.remove_special_chars(table(spark, sf, "dirty_customer").select("row_id", "email", "phone"))


@query("remove_special_documents", r"SELECT doc_id, regexp_replace(text, '[^A-Za-z0-9\s]', '', 'g') AS text FROM documents")
def remove_special_documents(spark, sf):
    return columns.remove_special_chars(table(spark, sf, "documents").select("doc_id", "text"))


@query("trim_spaces", r"SELECT row_id, regexp_replace(label, '^\s+|\s+$', '', 'g') AS label, brand FROM spaced_parts")
def trim_spaces(spark, sf):
    return columns.trim_spaces(table(spark, sf, "spaced_parts"))


@query("case_lower", "SELECT row_id, lower(name) AS name, lower(country) AS country FROM dirty_customer")
def case_lower(spark, sf):
    return columns.change_case(table(spark, sf, "dirty_customer").select("row_id", "name", "country"), "lower")


@query("case_upper", "SELECT conv_id, turn, upper(replace(text, 'ß', 'SS')) AS text FROM conversations")
def case_upper(spark, sf):
    return columns.change_case(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "upper")


@query("case_title", r"SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(text, '(\pL+|\PL+)'), lambda w: CASE WHEN w[1] = 'ß' THEN 'Ss' ELSE upper(w[1]) END || lower(w[2:])), '') AS text FROM conversations")
def case_title(spark, sf):
    return columns.change_case(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "title")


@query("label_encode", "SELECT row_id, CASE WHEN o_orderstatus IS NULL THEN -1 ELSE dense_rank() OVER (PARTITION BY o_orderstatus IS NULL ORDER BY o_orderstatus) - 1 END AS o_orderstatus, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority FROM null_orders")
def label_encode(spark, sf):
    return columns.label_encode(table(spark, sf, "null_orders").select("row_id", "o_orderstatus", "o_orderpriority"))


@query("one_hot_cells", "SELECT row_id, 'o_orderstatus' AS \"column\", o_orderstatus AS value FROM null_orders WHERE o_orderstatus IS NOT NULL UNION ALL SELECT row_id, 'o_orderpriority', o_orderpriority FROM null_orders WHERE o_orderpriority IS NOT NULL")
def one_hot_cells(spark, sf):
    return columns.one_hot_cells(table(spark, sf, "null_orders"), "row_id", ["o_orderstatus", "o_orderpriority"])


@query("one_hot", "SELECT row_id, coalesce(o_orderstatus = 'F', false) AS \"o_orderstatus_F\", coalesce(o_orderstatus = 'O', false) AS \"o_orderstatus_O\", coalesce(o_orderstatus = 'P', false) AS \"o_orderstatus_P\" FROM null_orders")
def one_hot(spark, sf):
    return columns.one_hot_encode(table(spark, sf, "null_orders").select("row_id", "o_orderstatus"))


@query("flatten_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS \"props.k\", event_type FROM events")
def flatten_props(spark, sf):
    schema = T.StructType([T.StructField("k", T.LongType())])
    nested = table(spark, sf, "events").select("event_id", F.from_json("props", schema).alias("props"), "event_type")
    return columns.flatten_structs(nested)
