"""Audited cleaning: what each step records, and the whole pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.tables import table
from tablesmith.functions import numbers
from tablesmith.operators.ordering import mark_row_id
from tablesmith.operators.values import duplicate_rows
from tablesmith.plans import audit, smart
from tablesmith.plans.audit import Audited
from tablesmith.session import spread

_RECORD = ["row_id", "column", "old_value", "new_value", "method", "confidence"]


def _step(spark, sf, view, step, **params):
    return step(Audited.start(table(spark, sf, view), "row_id"), **params).audit.select(*_RECORD)


def _records(selects: list[tuple[str, str, str, str, str, str]], view: str = "dirty_customer") -> str:
    """(column, new value, method, confidence, condition) per rule, as one SELECT each."""
    return "\nUNION ALL\n".join(
        f"""SELECT row_id, '{c}' AS "column", CAST({c} AS VARCHAR) AS old_value, {new} AS new_value, '{method}' AS method, CAST({conf} AS DOUBLE) AS confidence FROM {source} WHERE {where}"""
        for c, new, method, conf, where, source in ((*s, view) if len(s) == 5 else s for s in selects)
    )


_SENTINEL = "('', 'nan', 'na', 'n/a', 'none', 'null', 'nil', 'missing', 'unknown', 'undefined', '?', '-', '___', '(blank)', '[blank]')"
_TEXTS = ["name", "email", "gender", "country", "phone", "address", "signup_date", "website", "score_text", "segment"]


@query("smart_sentinels", _records([(c, "CAST(NULL AS VARCHAR)", "sentinel_detection", "1.0", f"lower(trim({c})) IN {_SENTINEL}") for c in _TEXTS]))
def smart_sentinels(spark, sf):
    return _step(spark, sf, "dirty_customer", smart.normalize_sentinels)


def _tidy(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


@query("smart_text", _records([(c, _tidy(c), "text_normalization", "0.99", f"{_tidy(c)} <> {c}") for c in _TEXTS]))
def smart_text(spark, sf):
    return _step(spark, sf, "dirty_customer", smart.clean_text)


@query("smart_text_documents")
def smart_text_documents(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "text")
    return smart.clean_text(Audited.start(documents, "doc_id")).data


def _words_raised(c: str) -> str:
    return f"array_to_string(list_transform(string_split(lower(trim({c})), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


@query("smart_names", _records([("name", _words_raised("name"), "name_standardization", "0.95", f"length(trim(name)) > 1 AND NOT regexp_matches(trim(name), '^[0-9]+$') AND {_words_raised('name')} <> trim(name)")]))
def smart_names(spark, sf):
    return _step(spark, sf, "dirty_customer", smart.standardize_names)


_GENDER = "CASE lower(trim(gender)) WHEN 'm' THEN 'Male' WHEN 'male' THEN 'Male' WHEN 'man' THEN 'Male' WHEN 'f' THEN 'Female' WHEN 'female' THEN 'Female' WHEN 'other' THEN 'Other' END"
_COUNTRY = "CASE lower(trim(country)) WHEN 'usa' THEN 'United States' WHEN 'u.k.' THEN 'United Kingdom' WHEN 'deutschland' THEN 'Germany' WHEN 'france' THEN 'France' END"


@query("smart_categories", _records([
    ("gender", _GENDER, "category_mapping", "0.98", f"{_GENDER} <> trim(gender)"),
    ("country", _COUNTRY, "category_mapping", "0.98", f"{_COUNTRY} <> trim(country)"),
]))
def smart_categories(spark, sf):
    return _step(spark, sf, "dirty_customer", smart.standardize_categories)


_VALID = r"'^[^@\s]+@[^@\s]+\.[^@\s]+$'"
_JOINED = "replace(trim(email), ' ', '')"
_DOMAIN = f"array_to_string(string_split({_JOINED}, '@')[2:], '.')"
_FIXED = f"CASE WHEN contains({_JOINED}, '@') THEN split_part({_JOINED}, '@', 1) || '@' || {_DOMAIN} || CASE WHEN contains({_DOMAIN}, '.') THEN '' ELSE '.com' END ELSE {_JOINED} END"


@query("smart_emails", _records([
    ("email", _FIXED, "email_repair", "0.85", f"NOT regexp_matches(trim(email), {_VALID}) AND regexp_matches({_FIXED}, {_VALID})"),
    ("email", "email", "invalid_email_flag", "0.0", f"NOT regexp_matches(trim(email), {_VALID}) AND NOT regexp_matches({_FIXED}, {_VALID})"),
]))
def smart_emails(spark, sf):
    return _step(spark, sf, "dirty_customer", smart.repair_emails)


_DAY = "strftime(coalesce(try_strptime(signup_date, '%Y-%m-%d'), try_strptime(signup_date, '%m/%d/%Y')), '%Y-%m-%d')"


@query("smart_dates", _records([("signup_date", _DAY, "date_standardization", "0.98", f"{_DAY} <> signup_date")]))
def smart_dates(spark, sf):
    return _step(spark, sf, "dirty_customer", smart.standardize_dates)


@query("smart_dates_typed", "SELECT event_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts FROM events")
def smart_dates_typed(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts")
    day = smart.standardize_dates(Audited.start(events, "event_id"), ["ts"]).data
    return day.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_DIGITS = r"regexp_replace(phone, '[^0-9]', '', 'g')"
_PHONE = f"""CASE WHEN length({_DIGITS}) > 10 THEN '+' || left({_DIGITS}, length({_DIGITS}) - 10) || '-' || substr(right({_DIGITS}, 10), 1, 3) || '-' || substr(right({_DIGITS}, 10), 4, 3) || '-' || right({_DIGITS}, 4)
 WHEN length({_DIGITS}) = 10 THEN left({_DIGITS}, 3) || '-' || substr({_DIGITS}, 4, 3) || '-' || right({_DIGITS}, 4) WHEN length({_DIGITS}) = 7 THEN left({_DIGITS}, 3) || '-' || right({_DIGITS}, 4) ELSE {_DIGITS} END"""


@query("smart_phones", _records([
    ("phone", _PHONE, "phone_standardization", "0.92", f"length({_DIGITS}) >= 7 AND {_PHONE} <> trim(phone)"),
    ("phone", "phone", "invalid_phone_flag", "0.0", f"length({_DIGITS}) < 7 AND trim(phone) <> ''"),
]))
def smart_phones(spark, sf):
    return _step(spark, sf, "dirty_customer", smart.standardize_phones)


_WORD = """CASE WHEN lower(regexp_replace(w, '[,.;]+$', '')) = 'st' THEN 'Street' || w[3:] WHEN lower(regexp_replace(w, '[,.;]+$', '')) = 'ave' THEN 'Avenue' || w[4:]
 WHEN lower(regexp_replace(w, '[^a-zA-Z]', '', 'g')) IN ('ca', 'ny', 'tx', 'wa') THEN upper(regexp_replace(w, '[^a-zA-Z]', '', 'g')) ELSE upper(w[1]) || w[2:] END"""
_ADDRESS = rf"array_to_string(list_transform(string_split(regexp_replace(trim(address), '\s+', ' ', 'g'), ' '), lambda w: {_WORD}), ' ')"


@query("smart_addresses", _records([("address", _ADDRESS, "address_standardization", "0.9", f"{_ADDRESS} <> trim(address)")]))
def smart_addresses(spark, sf):
    return _step(spark, sf, "dirty_customer", smart.standardize_addresses)


_NO_PROTOCOL = "NOT regexp_matches(trim(url), '^(https?|ftp)://')"


@query("smart_urls", _records([
    ("url", "'https://' || trim(url)", "url_standardization", "0.95", f"{_NO_PROTOCOL} AND starts_with(trim(url), 'www.')"),
    ("url", "'https://' || trim(url)", "url_standardization", "0.9", f"{_NO_PROTOCOL} AND NOT starts_with(trim(url), 'www.') AND contains(url, '.') AND NOT contains(trim(url), ' ')"),
], "dirty_pages"))
def smart_urls(spark, sf):
    return _step(spark, sf, "dirty_pages", smart.standardize_urls)


@query("smart_convert", "SELECT row_id, TRY_CAST(score_text AS DOUBLE) AS score_text, phone FROM dirty_customer")
def smart_convert(spark, sf):
    view = table(spark, sf, "dirty_customer").select("row_id", "score_text", "phone")
    return smart.convert_data_types(Audited.start(view, "row_id")).data


@query("smart_convert_audit", "SELECT row_id, score_text AS old_value, CAST(TRY_CAST(score_text AS DOUBLE) AS DOUBLE) AS new_value, CAST(0.95 AS DOUBLE) AS confidence FROM dirty_customer WHERE TRY_CAST(score_text AS DOUBLE) IS NOT NULL")
def smart_convert_audit(spark, sf):
    view = table(spark, sf, "dirty_customer").select("row_id", "score_text", "phone")
    log = smart.convert_data_types(Audited.start(view, "row_id")).audit
    return log.select("row_id", "old_value", F.col("new_value").cast("double").alias("new_value"), "confidence")


@query("convert_percentage", "SELECT row_id, TRY_CAST(regexp_replace(share_text, '[% ]', '', 'g') AS DOUBLE) / 100.0::DOUBLE AS share FROM priced_parts")
def convert_percentage(spark, sf):
    return table(spark, sf, "priced_parts").select("row_id", numbers.convert_value(F.col("share_text"), "percentage").alias("share"))


@query("convert_currency", "SELECT row_id, TRY_CAST(regexp_replace(price_text, '[$,]', '', 'g') AS DOUBLE) AS price FROM priced_parts")
def convert_currency(spark, sf):
    return table(spark, sf, "priced_parts").select("row_id", numbers.convert_value(F.col("price_text"), "currency").alias("price"))


@query("convert_int", "SELECT row_id, CAST(trunc(TRY_CAST(size_text AS DOUBLE)) AS BIGINT) AS size FROM priced_parts")
def convert_int(spark, sf):
    return table(spark, sf, "priced_parts").select("row_id", numbers.convert_value(F.col("size_text"), "int").alias("size"))


_IMPUTE = """SELECT row_id, 'o_totalprice' AS "column", CAST(NULL AS VARCHAR) AS old_value, round((SELECT quantile_cont(o_totalprice, 0.5) FROM null_orders), 3) AS number, CAST(NULL AS VARCHAR) AS word, 'median_imputation' AS method, CAST(0.9 AS DOUBLE) AS confidence FROM null_orders WHERE o_totalprice IS NULL
UNION ALL SELECT row_id, 'o_custkey', NULL, (SELECT quantile_cont(CAST(o_custkey AS DOUBLE), 0.5) FROM null_orders), NULL, 'median_imputation', 0.9 FROM null_orders WHERE o_custkey IS NULL
UNION ALL SELECT row_id, 'o_orderstatus', NULL, NULL, (SELECT o_orderstatus FROM null_orders WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), 'mode_imputation', 0.8 FROM null_orders WHERE o_orderstatus IS NULL
UNION ALL SELECT row_id, 'o_orderdate', NULL, NULL, NULL, 'ffill_bfill', 0.7 FROM null_orders WHERE o_orderdate IS NULL"""


@query("impute_audit", _IMPUTE)
def impute_audit(spark, sf):
    log = smart.impute_missing(Audited.start(table(spark, sf, "null_orders"), "row_id")).audit
    number = F.when(F.col("method") == "median_imputation", F.round(F.col("new_value").try_cast("double"), 3))
    word = F.when(F.col("method") == "mode_imputation", F.col("new_value"))
    return log.select("row_id", "column", "old_value", number.alias("number"), word.alias("word"), "method", "confidence")


@query("impute_dates", "SELECT row_id, coalesce(last_value(o_orderdate IGNORE NULLS) OVER (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(o_orderdate IGNORE NULLS) OVER (ORDER BY row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS o_orderdate FROM null_orders")
def impute_dates(spark, sf):
    view = table(spark, sf, "null_orders").select("row_id", "o_orderdate")
    return smart.impute_missing(Audited.start(view, "row_id")).data


def _flags(method, bounds, hit, confidence):
    return f"""SELECT row_id, o_totalprice AS old_value, '{method}' AS method, CAST({confidence} AS DOUBLE) AS confidence FROM null_orders, ({bounds}) WHERE {hit}"""


def _flagged(spark, sf, method):
    view = table(spark, sf, "null_orders").select("row_id", "o_totalprice")
    log = smart.flag_outliers(Audited.start(view, "row_id"), method=method).audit
    return log.select("row_id", F.col("old_value").cast("double").alias("old_value"), "method", "confidence")


@query("flag_outliers_iqr", _flags("iqr_outlier_flag", "SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM null_orders", "o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)", 0.9))
def flag_outliers_iqr(spark, sf):
    return _flagged(spark, sf, "iqr")


@query("flag_outliers_z", _flags("zscore_outlier_flag", "SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM null_orders", "abs((o_totalprice - m) / s) > 3", 0.85))
def flag_outliers_z(spark, sf):
    return _flagged(spark, sf, "zscore")


@query("flag_outliers_modz", _flags("modified_zscore_outlier_flag", "SELECT med, (SELECT quantile_cont(abs(o_totalprice - med), 0.5) FROM null_orders) AS mad FROM (SELECT quantile_cont(o_totalprice, 0.5) AS med FROM null_orders)", "abs(0.6745 * (o_totalprice - med) / mad) > 3.5", 0.88))
def flag_outliers_modz(spark, sf):
    return _flagged(spark, sf, "modified_zscore")


@query("dedup_guard_ok", "SELECT DISTINCT l_orderkey, l_partkey FROM few_copies")
def dedup_guard_ok(spark, sf):
    t = Audited.start(smart.add_row_id(table(spark, sf, "few_copies")), "row_id")
    return smart.remove_exact_duplicates(t).data.drop("row_id")


@query("dedup_guard_audit", "SELECT '*all*' AS \"column\", '(removed)' AS new_value, 'exact_duplicate_removal' AS method, CAST(count(*) - count(DISTINCT (l_orderkey, l_partkey)) AS BIGINT) AS n FROM few_copies")
def dedup_guard_audit(spark, sf):
    t = Audited.start(smart.add_row_id(table(spark, sf, "few_copies")), "row_id")
    log = smart.remove_exact_duplicates(t).audit
    return log.groupBy("column", "new_value", "method").agg(F.count(F.lit(1)).alias("n"))


@query("dedup_guard_halt", "SELECT count(*) AS \"rows\", CAST(count(*) - count(DISTINCT (text, lang)) AS BIGINT) AS duplicate_rows, (count(*) - count(DISTINCT (text, lang))) * 100.0 / count(*) > 5 AS halted FROM documents")
def dedup_guard_halt(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "text", "lang")
    t = smart.remove_exact_duplicates(Audited.start(mark_row_id(documents, "doc_id"), "doc_id"))
    return duplicate_rows(t.data, ["text", "lang"]).withColumn("halted", F.lit(t.halted))


@query("dedup_guard_key", "SELECT c_custkey, c_nationkey FROM customer")
def dedup_guard_key(spark, sf):
    """A key that is data is compared: rows that differ only there all stay."""
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return smart.remove_exact_duplicates(Audited.start(customers, "c_custkey")).data


@query("remove_empty_rows_audit", "SELECT row_id, 'empty_row_removal' AS method FROM blank_parts WHERE coalesce(trim(a), '') = '' AND coalesce(trim(b), '') = '' AND c IS NULL")
def remove_empty_rows_audit(spark, sf):
    t = smart.remove_empty_rows(Audited.start(table(spark, sf, "blank_parts"), "row_id"))
    return t.audit.select("row_id", "method")


_GIVEN = f"""SELECT row_id, CASE WHEN lower(trim(gender)) IN {_SENTINEL} THEN NULL ELSE gender END AS gender0, CASE WHEN lower(trim(country)) IN {_SENTINEL} THEN NULL ELSE country END AS country0,
 trim(name) AS name0, email, phone, address, signup_date, website, CASE WHEN lower(trim(score_text)) IN {_SENTINEL} THEN NULL ELSE score_text END AS score0, age, salary FROM dirty_customer"""


@query("smart_clean_rowlocal", f"""WITH g AS ({_GIVEN})
SELECT row_id, {_words_raised("name0")} AS name, CASE lower(gender0) WHEN 'm' THEN 'Male' WHEN 'man' THEN 'Male' WHEN 'f' THEN 'Female' WHEN 'female' THEN 'Female' WHEN 'other' THEN 'Other' END AS gender,
 CASE lower(country0) WHEN 'usa' THEN 'United States' WHEN 'u.k.' THEN 'United Kingdom' WHEN 'deutschland' THEN 'Germany' WHEN 'france' THEN 'France' END AS country,
 CASE WHEN regexp_matches({_FIXED}, {_VALID}) THEN {_FIXED} ELSE email END AS email, CASE WHEN length({_DIGITS}) >= 7 THEN {_PHONE} ELSE phone END AS phone, {_ADDRESS} AS address,
 coalesce({_DAY}, signup_date) AS signup_date, CASE WHEN regexp_matches(website, '^https?://') THEN website ELSE 'https://' || website END AS website FROM g""")
def smart_clean_rowlocal(spark, sf):
    view = table(spark, sf, "dirty_customer")
    cleaned = smart.smart_clean(spread(view), "row_id", steps=smart.ROW_LOCAL).data
    return cleaned.select("row_id", "name", "gender", "country", "email", "phone", "address", "signup_date", "website")


@query("smart_clean_pipeline")
def smart_clean_pipeline(spark, sf):
    return smart.smart_clean(spread(table(spark, sf, "dirty_customer")), "row_id").data


@query("smart_clean_summary", "SELECT count(*) AS rows_before, count(*) AS rows_after, false AS halted, '' AS halt_reason FROM null_orders")
def smart_clean_summary(spark, sf):
    view = table(spark, sf, "null_orders").withColumn("order_key", F.col("row_id"))
    return smart.smart_clean(spread(view), "row_id").summary.drop("cells_changed")


@query("smart_clean_dry_run", "SELECT 'median_imputation' AS method, count(*) FILTER (o_totalprice IS NULL) AS n FROM null_orders")
def smart_clean_dry_run(spark, sf):
    view = table(spark, sf, "null_orders").select("row_id", "o_totalprice")
    result = smart.smart_clean(view, "row_id", steps=["impute_missing"], dry_run=True)
    return audit.audit_by_method(result.audit)


@query("audit_by_method", f"""SELECT method, count(*) AS n FROM (SELECT 'sentinel_detection' AS method FROM (SELECT unnest([{", ".join(_TEXTS)}]) AS v FROM dirty_customer) WHERE lower(trim(v)) IN {_SENTINEL}
UNION ALL SELECT 'category_mapping' FROM dirty_customer WHERE {_GENDER} <> trim(gender) UNION ALL SELECT 'category_mapping' FROM dirty_customer WHERE {_COUNTRY} <> trim(country)
UNION ALL SELECT CASE WHEN regexp_matches({_FIXED}, {_VALID}) THEN 'email_repair' ELSE 'invalid_email_flag' END FROM dirty_customer WHERE NOT regexp_matches(trim(email), {_VALID})) GROUP BY 1""")
def audit_by_method(spark, sf):
    steps = ["normalize_sentinels", "standardize_categories", "repair_emails"]
    result = smart.smart_clean(table(spark, sf, "dirty_customer"), "row_id", steps=steps)
    return audit.audit_by_method(result.audit)


@query("cells_changed", f"SELECT count(*) FILTER ({_PHONE} <> trim(phone) AND length({_DIGITS}) >= 7) AS cells_changed FROM dirty_customer")
def cells_changed(spark, sf):
    t = Audited.start(table(spark, sf, "dirty_customer"), "row_id")
    return audit.cells_changed(smart.standardize_phones(t).audit)
