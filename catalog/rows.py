"""Row operators (projection, filter, row sets)."""

from __future__ import annotations

from catalog import query
from catalog.tables import table
from tablesmith.operators import rows


@query("preview_search", "SELECT * FROM part WHERE regexp_matches(lower(p_name), 'blue|ring') OR regexp_matches(lower(p_brand), 'blue|ring') OR regexp_matches(lower(p_type), 'blue|ring') OR regexp_matches(CAST(p_partkey AS VARCHAR), 'blue|ring') OR regexp_matches(CAST(p_size AS VARCHAR), 'blue|ring')")
def preview_search(spark, sf):
    return rows.search_rows(table(spark, sf, "part"), "BLUE|ring")


@query("preview_sorted_page", "SELECT row_id, o_totalprice, o_orderstatus FROM null_orders ORDER BY o_totalprice DESC NULLS LAST, row_id LIMIT 50 OFFSET 50")
def preview_sorted_page(spark, sf):
    view = table(spark, sf, "null_orders").select("row_id", "o_totalprice", "o_orderstatus")
    return rows.page(view, number=2, size=50, sort_by="o_totalprice", direction="desc", row_id="row_id")


@query("preview_totals", "SELECT count(*) AS total, CAST(greatest(ceil(count(*) / 50.0), 1) AS BIGINT) AS total_pages FROM part WHERE regexp_matches(lower(p_name), 'ring')  OR regexp_matches(lower(p_brand), 'ring') OR regexp_matches(lower(p_type), 'ring')")
def preview_totals(spark, sf):
    return rows.page_totals(table(spark, sf, "part"), size=50, search="ring")


_FILTERS = {
    "filter_eq": ("gender", "==", "M", "gender = 'M'"),
    "filter_ne": ("gender", "!=", "M", "gender IS DISTINCT FROM 'M'"),
    "filter_gt": ("age", ">", "50", "age > 50"),
    "filter_ge": ("age", ">=", 50, "age >= 50"),
    "filter_lt": ("salary", "<", "0", "salary < 0"),
    "filter_le": ("salary", "<=", 100.5, "salary <= 100.5"),
    "filter_contains": ("email", "contains", "U1.*EXAMPLE", "coalesce(regexp_matches(lower(email), 'u1.*example'), false)"),
    "filter_not_contains": ("email", "not_contains", "u1", "NOT coalesce(regexp_matches(lower(email), 'u1'), false)"),
    "filter_is_null": ("phone", "is_null", None, "phone IS NULL"),
    "filter_not_null": ("phone", "not_null", None, "phone IS NOT NULL"),
}


def _register_filter(name, column, op, value, sql):
    @query(name, f"SELECT * FROM dirty_customer WHERE {sql}")
    def run(spark, sf):
        return rows.filter_rows(table(spark, sf, "dirty_customer"), column, op, value)


for _name, _rule in _FILTERS.items():
    _register_filter(_name, *_rule)


@query("drop_nulls_any", "SELECT * FROM null_orders WHERE o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL AND o_totalprice IS NOT NULL AND o_orderdate IS NOT NULL AND o_orderpriority IS NOT NULL")
def drop_nulls_any(spark, sf):
    return rows.drop_nulls(table(spark, sf, "null_orders"))


@query("drop_nulls_all", "SELECT * FROM null_orders WHERE NOT (o_custkey IS NULL AND o_orderstatus IS NULL AND o_totalprice IS NULL)")
def drop_nulls_all(spark, sf):
    return rows.drop_nulls(table(spark, sf, "null_orders"), "all", ["o_custkey", "o_orderstatus", "o_totalprice"])


@query("dedup_full", "SELECT DISTINCT text, lang FROM documents")
def dedup_full(spark, sf):
    return rows.remove_duplicates(table(spark, sf, "many_copies"))


@query("dedup_subset_first", "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1")
def dedup_subset_first(spark, sf):
    return rows.remove_duplicates(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"], row_id="o_orderkey")


@query("sample_n")
def sample_n(spark, sf):
    return rows.sample_rows(table(spark, sf, "orders"), n=500, row_id="o_orderkey")


@query("sample_frac")
def sample_frac(spark, sf):
    return rows.sample_rows(table(spark, sf, "orders"), frac=0.2)


@query("find_documents", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 10")
def find_documents(spark, sf):
    return rows.find(
        table(spark, sf, "orders"),
        {"o_orderstatus": "F", "o_orderpriority": "5-LOW"},
        projection=["o_orderkey", "o_totalprice"],
        sort={"o_totalprice": -1, "o_orderkey": 1},
        offset=10,
        limit=100,
    )


@query("update_where", "SELECT * REPLACE (CASE WHEN p_brand = 'Brand#2' THEN 'PROMO' ELSE p_type END AS p_type, CASE WHEN p_brand = 'Brand#2' THEN 'Brand#0' ELSE p_brand END AS p_brand) FROM part")
def update_where(spark, sf):
    return rows.update_where(table(spark, sf, "part"), {"p_brand": "Brand#2"}, {"p_brand": "Brand#0", "p_type": "PROMO"})


@query("delete_where", "SELECT * FROM null_orders WHERE NOT coalesce(o_orderstatus = 'F' AND o_orderpriority = '1-URGENT', false)")
def delete_where(spark, sf):
    return rows.delete_where(table(spark, sf, "null_orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})


@query("affected_rows", "SELECT count(*) FILTER (o_orderstatus = 'F') AS affected FROM null_orders")
def affected_rows(spark, sf):
    return rows.affected_rows(table(spark, sf, "null_orders"), {"o_orderstatus": "F"})


@query("row_change", "SELECT (SELECT count(*) FROM orders) AS rows_before, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS rows_after")
def row_change(spark, sf):
    orders = table(spark, sf, "orders")
    return rows.row_change(orders, rows.filter_rows(orders, "o_orderstatus", "==", "F"))


@query("remove_empty_rows", "SELECT * FROM blank_parts WHERE NOT (coalesce(trim(a), '') = '' AND coalesce(trim(b), '') = '' AND c IS NULL)")
def remove_empty_rows(spark, sf):
    return rows.remove_empty_rows(table(spark, sf, "blank_parts"), ["a", "b", "c"])


