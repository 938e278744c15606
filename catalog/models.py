"""Training, prediction, clustering. Fitted numbers are not SQL; the counts around them are."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.tables import table
from tablesmith.operators import ml


def _items(spark, sf):
    numbered = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return numbered.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "c_acctbal", "c_mktsegment")


def _documents(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    words = F.size(F.split("text", " ")).alias("words")
    return joined.select("doc_id", "quality", "lang", "source", "n_chars", words)


@query("infer_tasks", "SELECT 'regression' AS price, 'classification' AS status, 'classification' AS lines FROM (SELECT count(DISTINCT o_totalprice) AS n FROM orders) WHERE n > 10")
def infer_tasks(spark, sf):
    orders = table(spark, sf, "orders")
    price, status = ml.infer_task(orders, "o_totalprice"), ml.infer_task(orders, "o_orderstatus")
    lines = ml.infer_task(table(spark, sf, "lineitem"), "l_linenumber")
    return spark.range(1).select(F.lit(price).alias("price"), F.lit(status).alias("status"), F.lit(lines).alias("lines"))


@query("feature_matrix")
def feature_matrix(spark, sf):
    view = table(spark, sf, "null_orders").select("row_id", "o_totalprice", "o_orderstatus", "o_orderpriority")
    stages, _, _ = ml.feature_stages(view, ["o_totalprice", "o_orderstatus", "o_orderpriority"])
    out = ml.Pipeline(stages=stages).fit(view).transform(view)
    return out.select("row_id", ml_vector_size("features"))


def ml_vector_size(name):
    from pyspark.ml.functions import vector_to_array

    return F.size(vector_to_array(F.col(name))).alias("width")


@query("split_counts", "SELECT o_orderstatus, count(*) AS \"rows\", CAST(round(count(*) * 0.2::DOUBLE) AS BIGINT) AS test_rows FROM orders GROUP BY 1")
def split_counts(spark, sf):
    split = ml.train_test_split(table(spark, sf, "orders"), "o_orderkey", 0.2, stratify="o_orderstatus")
    return split.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_test").alias("test_rows"))


@query("ml_linear")
def ml_linear(spark, sf):
    items = table(spark, sf, "lineitem").withColumn("line_id", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    features = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]
    return ml.train(items, "l_extendedprice", "line_id", features, model_type="linear_regression", task="regression").metrics


@query("ml_logistic")
def ml_logistic(spark, sf):
    return ml.train(_documents(spark, sf), "quality", "doc_id", model_type="logistic_regression").metrics


@query("ml_rf_reg")
def ml_rf_reg(spark, sf):
    return ml.train(_items(spark, sf), "o_totalprice", "o_orderkey").metrics


@query("ml_rf_clf")
def ml_rf_clf(spark, sf):
    return ml.train(_documents(spark, sf), "quality", "doc_id").metrics


@query("ml_metrics", "SELECT round(1 - sum((o_totalprice - p) * (o_totalprice - p)) / (var_pop(o_totalprice) * count(*)), 6) AS r2, round(avg(abs(o_totalprice - p)), 4) AS mae, round(sqrt(avg((o_totalprice - p) * (o_totalprice - p))), 4) AS rmse FROM (SELECT o_totalprice, o_totalprice * 0.9 + 1000 AS p FROM orders)")
def ml_metrics(spark, sf):
    scored = table(spark, sf, "orders").withColumn("prediction", F.col("o_totalprice") * 0.9 + 1000)
    out = ml.regression_metrics(scored, "o_totalprice")
    return out.select(F.round("r2", 6).alias("r2"), F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"))


@query("ml_accuracy", "SELECT round(avg(CAST(o_orderstatus = 'O' AS INTEGER)), 6) AS accuracy FROM orders")
def ml_accuracy(spark, sf):
    scored = table(spark, sf, "orders").withColumn("prediction", F.lit("O"))
    return ml.accuracy(scored, "o_orderstatus").select(F.round("accuracy", 6).alias("accuracy"))


@query("ml_predict")
def ml_predict(spark, sf):
    documents = _documents(spark, sf)
    trained = ml.train(documents, "quality", "doc_id", model_type="logistic_regression")
    return ml.predict(trained, documents).select("doc_id", "prediction")


@query("cluster_sizes")
def cluster_sizes(spark, sf):
    return ml.cluster(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"]).sizes


@query("cluster_labels")
def cluster_labels(spark, sf):
    view = table(spark, sf, "null_orders").select("row_id", "o_totalprice", "o_custkey")
    return ml.cluster(view, ["o_totalprice", "o_custkey"], n_clusters=4, n_init=3).data.select("row_id", "cluster")


@query("cluster_unlabelled", "SELECT count(*) FILTER (o_totalprice IS NULL OR o_custkey IS NULL) AS unlabelled, count(*) AS \"rows\" FROM null_orders")
def cluster_unlabelled(spark, sf):
    labelled = cluster_labels(spark, sf)
    return labelled.agg(F.count_if(F.col("cluster").isNull()).alias("unlabelled"), F.count(F.lit(1)).alias("rows"))
