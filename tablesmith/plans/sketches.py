"""Approximate column statistics from sketches that can be merged and kept.

For each part of a table (a file, or all of it) and column there is one row: exact counts, extremes
and moments, a HyperLogLog sketch for distinct values, a KLL sketch for quantiles of numbers and a
frequent-items sketch for the top value of other columns. Rows of different parts merge into one like
them, in any order, so a store with a row for each file is brought up to date by reading new files only.

Bounds: distinct counts are within 5 % (three standard errors of 1.6 %), the rank of a quantile within
1 %, and a top value's count is short by at most the rows over ``TRACKED`` times 3.5.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablesmith.functions.numbers import percent
from tablesmith.types import col, column_types, nan_to_null, numeric_columns, q, select_columns

DISTINCT_LOG2 = 12
QUANTILE_K = 800
TRACKED = 10_000
DISTINCT_ERROR, RANK_ERROR = 0.05, 0.01
# Quantile sketches (some kilobytes each) that one row holds while they are merged.
_MERGED_AT_ONCE = 128

_PARTS = ("part", "column", "dtype", "rows", "missing", "min", "max", "mean", "m2", "distinct", "quantiles", "frequent")


def sketch_columns(df: DataFrame, columns: Sequence[str] | None = None, part: Column | None = None) -> DataFrame:
    """One row for each part and column; without ``part`` the whole table is one."""
    names, kinds = select_columns(df, columns), column_types(df)
    numeric = set(numeric_columns(df, names))

    def measured(c: str) -> Column:
        number = f"CAST({q(c)} AS DOUBLE)" if c in numeric else "CAST(NULL AS DOUBLE)"
        other = "CAST(NULL AS STRING)" if c in numeric else f"CAST({q(c)} AS STRING)"
        return F.struct(
            F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"), F.count(F.lit(1)).alias("rows"), F.count_if(col(c).isNull()).alias("missing"),
            F.expr(f"min({number})").alias("min"), F.expr(f"max({number})").alias("max"), F.expr(f"avg({number})").alias("mean"),
            F.expr(f"var_pop({number}) * count({number})").alias("m2"),
            F.expr(f"hll_sketch_agg(CASE WHEN {q(c)} IS NOT NULL THEN xxhash64({q(c)}) END, {DISTINCT_LOG2})").alias("distinct"),
            F.expr(f"kll_sketch_agg_double({number}, {QUANTILE_K})").alias("quantiles"),
            F.expr(f"approx_top_k_accumulate({other}, {TRACKED})").alias("frequent"),
        )

    grouped = df.groupBy(*([part.alias("part")] if part is not None else []))
    each = grouped.agg(*[measured(c).alias(f"m{i}") for i, c in enumerate(names)])
    where = F.col("part") if part is not None else F.lit(None).cast("string").alias("part")
    return each.select(where, F.inline(F.array(*[f"m{i}" for i in range(len(names))]))).select(*_PARTS)


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """One row for each column, as ``sketch_columns`` would make of all parts together; ``part`` is null."""
    known = F.col("rows") - F.col("missing")
    total = F.sum(F.col("mean") * known).over(Window.partitionBy("column")) / F.sum(F.when(F.col("mean").isNotNull(), known)).over(Window.partitionBy("column"))
    centred = sketches.withColumn("all_mean", total).withColumn("m2", F.col("m2") + known * (F.col("mean") - F.col("all_mean")) ** 2)
    plain = centred.groupBy("column").agg(
        F.first("dtype").alias("dtype"), F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.first("all_mean").alias("mean"), F.sum("m2").alias("m2"), F.hll_union_agg("distinct").alias("distinct"),
        F.expr(f"approx_top_k_combine(frequent, {TRACKED})").alias("frequent"),
    )
    # quantile sketches merge two by two: a bounded number in one row, in rounds
    rows = sketches.where(F.col("quantiles").isNotNull()).select("column", F.xxhash64("part").alias("at"), "quantiles")
    most = rows.groupBy("column").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    while most > 1:
        groups = -(-most // _MERGED_AT_ONCE)
        rows = rows.groupBy("column", F.pmod("at", F.lit(groups)).alias("at")).agg(F.collect_list("quantiles").alias("each"))
        rest = F.slice("each", 2, F.greatest(F.size("each") - 1, F.lit(0)))
        merged = F.aggregate(rest, F.get("each", F.lit(0)), lambda a, b: F.kll_sketch_merge_double(a, b))
        rows = rows.select("column", "at", merged.alias("quantiles"))
        most = groups if groups < most else 1
    joined = plain.join(rows.select("column", "quantiles"), "column", "left")
    return joined.select(F.lit(None).cast("string").alias("part"), *_PARTS[1:])


def estimate(sketches: DataFrame) -> DataFrame:
    """The columns of ``profile.column_stats``, from one row of sketches for each column."""
    known = F.col("rows") - F.col("missing")
    top = F.get(F.expr("approx_top_k_estimate(frequent, 1)"), F.lit(0))
    number = F.col("dtype").isin("integer", "float")
    median = F.when(known > 0, F.expr("CASE WHEN rows > missing THEN kll_sketch_get_quantile_double(quantiles, 0.5D) END"))
    return sketches.select(
        F.col("column").alias("name"), "dtype", "missing", percent(F.col("missing"), F.col("rows")).alias("missing_pct"),
        F.least(F.hll_sketch_estimate("distinct"), known).alias("unique"), "min", "max", F.bround("mean", 4).alias("mean"),
        F.bround(F.when(known > 1, F.sqrt(F.col("m2") / (known - 1))), 4).alias("std"),
        F.when(number, median).alias("median"),
        F.when(~number, top["item"]).alias("top"), F.when(~number, top["count"]).alias("top_count"),
    )


def update_store(spark: SparkSession, path: str, store: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Sketches of all Parquet files below ``path``, a row for each file and column, kept in ``store``.

    Only files that the store doesn't know are read. Files are taken for what they were when first
    read, as Spark gives new files new names; files that are gone leave the answer, not the store.
    """
    table = spark.read.parquet(path)
    files = table.inputFiles()
    there = spark._jvm.org.apache.hadoop.fs.Path(store)
    exists = there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
    known = {r[0] for r in spark.read.parquet(store).select("part").distinct().collect()} if exists else set()
    fresh = [f for f in files if f not in known]  # one name a file, as in Spark's own list of them
    if fresh:
        rows = nan_to_null(spark.read.schema(table.schema).parquet(*fresh).withColumn("__file", F.input_file_name()))
        sketch_columns(rows, select_columns(table, columns), F.col("__file")).write.mode("append").parquet(store)
    wanted = spark.createDataFrame([(f,) for f in files], "part string")
    return spark.read.parquet(store).join(wanted, "part", "left_semi").select(*_PARTS)
