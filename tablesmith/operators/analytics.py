"""Histogram, value counts, correlation, grouped aggregates, overview."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.operators.quantiles import grouped_median
from tablesmith.types import categorical_columns, col, numeric_columns, require_columns

# Up to so many pairs are summed by expressions; more by products of blocks of columns.
PAIRS_PER_PASS = 60
COLUMN_BLOCK = 64


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """``(bin_index, bin, n)``: equal-width bins, the last one closed on the right, empty ones kept.

    ``bin`` is the left edge, rounded. A constant column gets the range x - 0.5 .. x + 0.5. A value
    on an edge belongs to the bin it opens, checked against the edges themselves.
    """
    if not 1 <= bins <= 200:
        raise ValueError("bins is 1..200")
    empty = df.sparkSession.createDataFrame([], "bin_index bigint, bin double, n bigint")
    if column not in numeric_columns(df):
        return empty
    low, high = df.agg(F.min(col(column)).cast("double"), F.max(col(column)).cast("double")).first()
    if low is None:
        return empty
    if low == high:
        low, high = low - 0.5, high + 0.5
    step = (high - low) / bins
    x = col(column).cast("double")

    def edge(i: Column) -> Column:
        return F.lit(low) + i * F.lit(step)

    guess = F.least(F.floor((x - F.lit(low)) / F.lit(high - low) * F.lit(float(bins))), F.lit(bins - 1))
    guess = guess.cast("bigint")
    placed = (
        F.when(x < edge(guess), guess - 1)
        .when((guess < bins - 1) & (x >= edge(guess + 1)), guess + 1)
        .otherwise(guess)
    )
    counts = df.where(col(column).isNotNull()).groupBy(placed.alias("bin_index")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin_index"))
    return every.join(counts, "bin_index", "left").select(
        "bin_index",
        F.bround(edge(F.col("bin_index")), 2).alias("bin"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def value_counts(df: DataFrame, column: str, top: int = 15) -> DataFrame:
    """``(name, value)``: the most frequent non-null values; ties in value order."""
    require_columns(df, [column])
    counts = df.where(col(column).isNotNull()).groupBy(col(column).alias("name")).agg(F.count(F.lit(1)).alias("value"))
    return counts.orderBy(F.desc("value"), F.asc("name")).limit(top)


_AGGREGATES = {
    "sum": lambda v, r: F.coalesce(F.sum(v), F.lit(0)),
    "mean": lambda v, r: F.avg(v),
    "min": lambda v, r: F.min(v),
    "max": lambda v, r: F.max(v),
    "count": lambda v, r: F.count(v),
    "nunique": lambda v, r: F.count_distinct(v),
    "std": lambda v, r: F.stddev_samp(v),
    "var": lambda v, r: F.var_samp(v),
    "size": lambda v, r: F.count(F.lit(1)),
    "prod": lambda v, r: F.product(v),
    "first": lambda v, r: F.min_by(v, F.when(v.isNotNull(), r)),
    "last": lambda v, r: F.max_by(v, F.when(v.isNotNull(), r)),
}


def aggregate(
    df: DataFrame, group_by: str, metric: str, agg: str = "sum", top: int | None = 20, row_id: str | None = None
) -> DataFrame:
    """``(name, value)``: a numeric metric per non-null group, largest first.

    ``first`` and ``last`` need ``row_id``, the column that orders the rows.
    """
    require_columns(df, [group_by, metric])
    if metric not in numeric_columns(df):
        raise ValueError(f"'{metric}' is not numeric")
    if agg != "median" and agg not in _AGGREGATES:
        raise ValueError(f"unknown aggregate '{agg}'; one of median, {', '.join(_AGGREGATES)}")
    if agg in ("first", "last") and row_id is None:
        raise ValueError(f"{agg} needs row_id, the column that orders the rows")
    rows = df.where(col(group_by).isNotNull())
    if agg == "median":
        grouped = grouped_median(rows, group_by, metric).withColumnRenamed(group_by, "name")
    else:
        expr = _AGGREGATES[agg](col(metric), col(row_id) if row_id else None)
        grouped = rows.groupBy(col(group_by).alias("name")).agg(expr.alias("value"))
    if top is None:
        return grouped
    return grouped.orderBy(F.desc_nulls_last("value"), F.asc("name")).limit(top)


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(x, y, r)`` for each pair of numeric columns, x before y in schema order.

    Rows count where both values are known; r is null when either is constant there. A first
    pass takes the means, so that the second is plain sums of centred products: cheap per row, and
    without the cancellation that sums of raw squares would suffer.
    """
    names = numeric_columns(df, columns)
    pairs = list(itertools.combinations(names, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "x string, y string, r double")
    seen = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.struct(F.avg(col(c)), F.count(col(c))).alias(f"c{i}") for i, c in enumerate(names)]
    ).first()
    whole = {c: seen[f"c{i}"][1] == seen["rows"] for i, c in enumerate(names)}
    centred = df.select(
        *[(col(c).cast("double") - F.lit(seen[f"c{i}"][0] or 0.0)).alias(f"v{i}") for i, c in enumerate(names)]
    )
    if len(pairs) > PAIRS_PER_PASS:
        return _wide_pairs(centred, names).where("x <> y")
    return _pair_sums(centred, pairs, {c: f"v{i}" for i, c in enumerate(names)}, whole)


def _wide_pairs(centred: DataFrame, names: list[str]) -> DataFrame:
    """``(x, y, r)`` of all pairs (each column with itself too) in one pass, by products of column blocks.

    Gaps are zeros next to a mask: the sums over rows that know both columns are products of values with
    values, values with masks and masks with masks. Each task adds them up over all its rows; there are
    as many tasks as the cluster runs at once, or a few times that, however long the table is. The tasks' blocks
    are then added one after the other where they meet, so no more than one sum is held.
    """
    width, size = len(names), COLUMN_BLOCK
    blocks = [(i, j) for i in range(0, width, size) for j in range(i, width, size)]

    def added(batches):
        import numpy as np
        import pyarrow as pa

        sums = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns])
                m = (~np.isnan(x)).astype(float)
                x = np.nan_to_num(x, nan=0.0, posinf=np.inf, neginf=-np.inf)
                q = x * x
                whole = [m.T @ m, x.T @ m, m.T @ x, q.T @ m, m.T @ q, x.T @ x]
                sums = whole if sums is None else [a + b for a, b in zip(sums, whole)]
        for k, (i, j) in enumerate(blocks if sums is not None else ()):
            own = np.stack([s[i : i + size, j : j + size] for s in sums])
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([own.tobytes()])], names=["block", "sums"])

    def related(batches):
        import numpy as np
        import pyarrow as pa

        def pairs(k: int, total: np.ndarray) -> pa.RecordBatch:
            i, j = blocks[k]
            n, sx, sy, sxx, syy, xy = total.reshape(6, min(size, width - i), min(size, width - j))
            with np.errstate(all="ignore"):
                vx, vy = sxx - sx * sx / n, syy - sy * sy / n
                r = (xy - sx * sy / n) / np.sqrt(vx * vy)
            # rounding leaves a constant column a spread of about 1e-16 of its size
            known = (n > 0) & (vx > sxx * 1e-12) & (vy > syy * 1e-12)
            a, b = np.nonzero(np.ones_like(n))
            later = a + i <= b + j
            a, b = a[later], b[later]
            cols = [pa.array([names[x] for x in (a + i).tolist()]), pa.array([names[x] for x in (b + j).tolist()])]
            return pa.RecordBatch.from_arrays([*cols, pa.array(np.where(a + i == b + j, 1.0, r[a, b]), mask=~known[a, b])], names=["x", "y", "r"])

        now, total = None, None
        for batch in batches:
            for k, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(own.as_buffer(), float)
                if k != now:
                    if now is not None:
                        yield pairs(now, total)
                    now, total = k, part
                else:
                    total = total + part
        if now is not None:
            yield pairs(now, total)

    tasks = 4 * centred.sparkSession.sparkContext.defaultParallelism
    parts = centred.coalesce(tasks).mapInArrow(added, "block int, sums binary")
    shape = lambda k: min(size, width - blocks[k][0]) * min(size, width - blocks[k][1])
    # a table without rows has all pairs too
    nothing = centred.sparkSession.createDataFrame([(k, bytes(48 * shape(k))) for k in range(len(blocks))], "block int, sums binary")
    return parts.unionAll(nothing).repartition("block").sortWithinPartitions("block").mapInArrow(related, "x string, y string, r double")


def _pair_sums(centred: DataFrame, pairs: list[tuple[str, str]], place: dict[str, str], whole: dict[str, bool]) -> DataFrame:
    sums = {"n": "CAST(count(1) AS DOUBLE)"}

    def need(name: str, value: str) -> str:
        sums.setdefault(name, f"sum({value})")
        return name

    cells = []
    for a, b in pairs:
        x, y = place[a], place[b]
        xy = need(f"{x}_{y}", f"{x} * {y}")
        if whole[a] and whole[b]:
            # no gaps: the sums of one column serve all of its pairs
            n, sx, sy = "n", need(f"{x}_s", x), need(f"{y}_s", y)
            sxx, syy = need(f"{x}_q", f"{x} * {x}"), need(f"{y}_q", f"{y} * {y}")
        else:
            both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
            n, sx, sy, sxx, syy = (
                need(f"{xy}_{k}", f"CASE WHEN {both} THEN {v} END")
                for k, v in (("n", "1D"), ("x", x), ("y", y), ("xx", f"{x} * {x}"), ("yy", f"{y} * {y}"))
            )
        vx, vy = f"({sxx} - {sx} * {sx} / {n})", f"({syy} - {sy} * {sy} / {n})"
        # rounding leaves a constant column a spread of about 1e-16 of its size
        r = f"CASE WHEN {n} > 0 AND {vx} > {sxx} * 1e-12D AND {vy} > {syy} * 1e-12D THEN ({xy} - {sx} * {sy} / {n}) / sqrt({vx} * {vy}) END"
        cells.append((a, b, r))
    row = centred.agg(*[F.expr(v).alias(k) for k, v in sums.items()])
    measured = row.select(*[F.expr(r).alias(f"r{i}") for i, (_, _, r) in enumerate(cells)])
    named = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{i}").alias("r")) for i, (a, b, _) in enumerate(cells)]
    return measured.select(F.inline(F.array(*named)))


def correlation(df: DataFrame, columns: Sequence[str] | None = None, digits: int | None = 3) -> DataFrame:
    """``(x, y, value)``: the full symmetric matrix in long form."""
    names = numeric_columns(df, columns)
    pairs = correlation_pairs(df, names)
    known = df.agg(*[(F.stddev_pop(col(c)) > 0).alias(f"s{i}") for i, c in enumerate(names)]) if names else None
    if known is None:
        return df.sparkSession.createDataFrame([], "x string, y string, value double")
    diagonal = known.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("x"), F.lit(c).alias("y"), F.when(F.col(f"s{i}"), F.lit(1.0)).alias("r")
                    )
                    for i, c in enumerate(names)
                ]
            )
        )
    )
    both_ways = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("x"), F.col("y"), F.col("r")),
                F.struct(F.col("y").alias("x"), F.col("x").alias("y"), F.col("r")),
            )
        )
    )
    value = F.col("r") if digits is None else F.bround("r", digits)
    return both_ways.unionByName(diagonal).select("x", "y", value.alias("value"))


def overview_kpis(df: DataFrame) -> DataFrame:
    """One row ``(rows, columns, numeric_columns, categorical_columns)``."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.lit(len(numeric_columns(df))).cast("bigint").alias("numeric_columns"),
        F.lit(len(categorical_columns(df))).cast("bigint").alias("categorical_columns"),
    )


def overview(df: DataFrame) -> dict[str, DataFrame]:
    """The dashboard tables: KPIs, first numeric histogram, first categorical breakdown, correlation."""
    numeric, categorical = numeric_columns(df), categorical_columns(df)
    out = {"kpis": overview_kpis(df)}
    if numeric:
        out["histogram"] = histogram(df, numeric[0])
    if categorical:
        out["category_breakdown"] = value_counts(df, categorical[0])
    if len(numeric) >= 2:
        out["correlation"] = correlation(df)
    return out
