"""Exact order statistics that never gather a column (or a hot group) in one task.

Spark's ``percentile`` keeps every distinct value of a group in one buffer. That is fine for
small groups and used for them. Above a checked size the ranks are found by narrowing: a
mergeable sketch proposes an interval around each wanted rank, an exact count confirms it, and
the next look is only inside. What moves is one sketch per task and the few values between the
bounds, combined per task. The counts make the answer exact whatever the sketch said, and a value
repeated by a third of all rows ends a search instead of stalling it.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablesmith.session import broadcast_if_small, durable, first_row
from tablesmith.types import col

# Rows x columns up to which one percentile aggregate answers for all columns.
DIRECT_CELLS = 200_000
# Rows of a group up to which a percentile buffer holds its values.
DIRECT_GROUP_ROWS = 1_000_000
# Values between the sketched bounds of one quantile that a window may sort in one task.
WINDOW_ROWS = 5_000_000
# Values of one group that may be sorted inside a task at the end of a search.
GATHER_ROWS = 100_000
_GRID = 512
_ACCURACY = 10_000


def order_statistics(
    df: DataFrame, key: str, value: str, ranks: DataFrame, gather_rows: int = GATHER_ROWS
) -> DataFrame:
    """``(key, rank, answer)`` for the zero-based ranks in ``ranks(key, rank, size)``.

    ``size`` is the group's number of non-null values.
    """
    data = df.select(col(key).alias("key"), col(value).cast("double").alias("v")).where("v IS NOT NULL")
    none = F.lit(None).cast("double")
    state = durable(
        ranks.select(
            "key", "rank", none.alias("lo"), none.alias("hi"), F.lit(0).cast("bigint").alias("below"),
            F.col("size").alias("inside"), none.alias("answer"),
        )
    )
    within = "(lo IS NULL OR v > lo) AND (hi IS NULL OR v < hi)"
    grid = F.array(*[F.lit(i / _GRID) for i in range(_GRID + 1)])
    while True:
        searching = state.where("answer IS NULL")
        largest = searching.agg(F.max("inside")).first()[0]
        if largest is None:
            return state.select("key", "rank", "answer")
        if largest <= gather_rows:
            break
        sketch = (
            data.join(broadcast_if_small(searching), "key")
            .where(within)
            .groupBy("key", "rank")
            .agg(F.percentile_approx("v", grid, F.lit(_ACCURACY)).alias("marks"))
        )
        position = F.floor((F.col("rank") - F.col("below")) * F.lit(float(_GRID)) / F.col("inside"))
        proposed = searching.join(sketch, ["key", "rank"]).select(
            "key", "rank", "lo", "hi", "below",
            F.get("marks", F.greatest(position - 2, F.lit(0)).cast("int")).alias("a"),
            F.get("marks", F.least(position + 3, F.lit(_GRID)).cast("int")).alias("b"),
        )
        proposed = durable(proposed)
        seen = (
            data.join(broadcast_if_small(proposed), "key")
            .where(within)
            .groupBy("key", "rank", "lo", "hi", "below", "a", "b")
            .agg(
                F.count_if(F.col("v") < F.col("a")).alias("left"),
                F.count_if(F.col("v") == F.col("a")).alias("at_a"),
                F.count_if((F.col("v") > F.col("a")) & (F.col("v") < F.col("b"))).alias("mid"),
                F.count_if((F.col("v") == F.col("b")) & (F.col("b") > F.col("a"))).alias("at_b"),
                F.count(F.lit(1)).alias("all"),
            )
        )
        r = F.col("rank") - F.col("below")
        to_a = F.col("left") + F.col("at_a")
        to_mid = to_a + F.col("mid")
        to_b = to_mid + F.col("at_b")

        def choose(left, at_a, mid, at_b, right, r=r, to_a=to_a, to_mid=to_mid, to_b=to_b):
            return (
                F.when(r < F.col("left"), left)
                .when(r < to_a, at_a)
                .when(r < to_mid, mid)
                .when(r < to_b, at_b)
                .otherwise(right)
            )

        lo, hi, a, b, below = (F.col(n) for n in ("lo", "hi", "a", "b", "below"))
        narrowed = seen.select(
            "key",
            "rank",
            choose(lo, lo, a, lo, b).alias("lo"),
            choose(a, hi, b, hi, hi).alias("hi"),
            choose(below, below, below + to_a, below, below + to_b).alias("below"),
            choose(F.col("left"), F.lit(0), F.col("mid"), F.lit(0), F.col("all") - to_b)
            .cast("bigint")
            .alias("inside"),
            choose(none, a, none, b, none).alias("answer"),
        )
        state = durable(state.where("answer IS NOT NULL").unionByName(narrowed))
    last = (
        data.join(broadcast_if_small(searching), "key")
        .where(within)
        .groupBy("key", "rank", "below")
        .agg(F.sort_array(F.collect_list("v")).alias("vs"))
        .select("key", "rank", F.get("vs", (F.col("rank") - F.col("below")).cast("int")).alias("answer"))
    )
    return state.where("answer IS NOT NULL").select("key", "rank", "answer").unionByName(last)


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str] | Mapping[str, Column],
    probabilities: Sequence[float],
    direct_cells: int = DIRECT_CELLS,
) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles of each column, ignoring nulls.

    The answer is one number per column and probability, so it is returned to the driver
    and used as literals by the callers (which lets bounds reach the scan as filters).
    """
    exprs = dict(columns) if isinstance(columns, Mapping) else {c: col(c) for c in columns}
    if not exprs:
        return {}
    names = list(exprs)
    table = df.select(*[exprs[n].cast("double").alias(f"v{i}") for i, n in enumerate(names)])
    values = [f"v{i}" for i in range(len(names))]
    if table.count() * len(names) <= direct_cells:
        probs = F.array(*[F.lit(float(p)) for p in probabilities])
        row = first_row(table.agg(*[F.percentile(F.col(v), probs).alias(v) for v in values]))
        return {n: list(row[v] or [None] * len(probabilities)) for n, v in zip(names, values)}

    found = _bracketed(table, values, probabilities)
    return {n: found[v] for n, v in zip(names, values)}


def _bracketed(table: DataFrame, values: list[str], probabilities: Sequence[float]) -> dict[str, list[float | None]]:
    """Three column-pruned passes: sketch bounds around each rank, count below and between them,
    look only at the values between."""
    margin = 3 / _ACCURACY
    shares = [x for p in probabilities for x in (max(p - margin, 0.0), min(p + margin, 1.0))]
    wanted = F.array(*[F.lit(x) for x in shares])
    sketched = first_row(
        table.agg(*[F.struct(F.count(v).alias("n"), F.percentile_approx(v, wanted, F.lit(_ACCURACY)).alias("at")).alias(v) for v in values])
    )
    targets = []  # (key, column, probability, low bound or None, high bound or None)
    for v in values:
        if sketched[v]["n"]:
            for i, p in enumerate(probabilities):
                low = sketched[v]["at"][2 * i] if p > margin else None
                high = sketched[v]["at"][2 * i + 1] if p < 1 - margin else None
                targets.append((f"{v}:{i}", v, p, low, high))
    if not targets:
        return {v: [None] * len(probabilities) for v in values}

    def between(v: str, low: float | None, high: float | None) -> Column:
        inside = F.col(v).isNotNull()
        inside = inside if low is None else inside & (F.col(v) >= F.lit(low))
        return inside if high is None else inside & (F.col(v) <= F.lit(high))

    counts = []
    for key, v, _, low, high in targets:
        below = F.lit(0).cast("bigint") if low is None else F.count_if(F.col(v) < F.lit(low))
        counts.append(F.struct(below, F.count_if(between(v, low, high))).alias(key))
    counted = first_row(table.agg(*counts))

    ranks, offsets, found, open_targets = [], {}, {}, []
    for key, v, p, low, high in targets:
        n, at = sketched[v]["n"], (sketched[v]["n"] - 1) * p
        below, inside = counted[key]
        if not (below <= math.floor(at) and math.ceil(at) < below + inside):
            # the sketch missed: look at the whole column instead
            low, high, below, inside = None, None, 0, n
        offsets[key] = below
        wanted_ranks = {math.floor(at) - below, math.ceil(at) - below}
        if low is not None and low == high:
            found |= {(key, rank): low for rank in wanted_ranks}
        else:
            open_targets.append((key, between(v, low, high), F.col(v)))
            ranks += [(key, rank, inside) for rank in wanted_ranks]
    if ranks:
        found |= _look_inside(table, open_targets, ranks)
    out: dict[str, list[float | None]] = {v: [None] * len(probabilities) for v in values}
    for key, v, p, _, _ in targets:
        at = (sketched[v]["n"] - 1) * p
        low, high = (found[key, rank - offsets[key]] for rank in (math.floor(at), math.ceil(at)))
        out[v][int(key.split(":")[1])] = low + (high - low) * (at - math.floor(at))
    return out


def _look_inside(
    table: DataFrame, targets: list[tuple[str, Column, Column]], ranks: list[tuple[str, int, int]]
) -> dict[tuple[str, int], float]:
    """The values at ``(key, rank, size)`` among the rows that meet each key's condition."""
    rows = table.where(functools.reduce(operator.or_, [inside for _, inside, _ in targets]))
    cells = [F.struct(F.lit(key).alias("key"), F.when(inside, v).alias("v")) for key, inside, v in targets]
    long = rows.select(F.inline(F.array(*cells))).where("v IS NOT NULL")
    ranked = table.sparkSession.createDataFrame(ranks, "key string, rank bigint, size bigint")
    if max(r[2] for r in ranks) > WINDOW_ROWS:
        answers = order_statistics(long, "key", "v", ranked)
    else:
        tallied = long.groupBy("key", "v").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(W.partitionBy("key").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow))
        placed = tallied.withColumn("last", upto - 1).withColumn("first", F.col("last") - F.col("n") + 1)
        hit = F.col("rank").between(F.col("first"), F.col("last"))
        answers = placed.join(F.broadcast(ranked), "key").where(hit).select("key", "rank", F.col("v").alias("answer"))
    return {(r["key"], r["rank"]): r["answer"] for r in answers.collect()}


def median_absolute_deviation(df: DataFrame, medians: Mapping[str, float | None]) -> dict[str, float | None]:
    """Median of ``|x - median|`` per column."""
    known = {c: F.abs(col(c) - F.lit(m)) for c, m in medians.items() if m is not None}
    found = exact_quantiles(df, known, [0.5])
    return {c: found[c][0] if c in found else None for c in medians}


def grouped_median(df: DataFrame, group: str, value: str, direct_rows: int = DIRECT_GROUP_ROWS) -> DataFrame:
    """``(group, value)`` with the exact median per group; no group is gathered above a checked size."""
    data = df.select(col(group).alias("key"), col(value).cast("double").alias("v"))
    sizes = data.groupBy("key").agg(F.count("v").alias("size"))
    largest = sizes.agg(F.max("size")).first()[0] or 0
    if largest <= direct_rows:
        return data.groupBy("key").agg(F.percentile("v", 0.5).alias("value")).withColumnRenamed("key", group)
    ranks = sizes.where("size > 0").select(
        "key", "size", F.explode(F.array_distinct(F.array(F.expr("(size - 1) div 2"), F.expr("size div 2")))).alias("rank")
    )
    answers = order_statistics(data, "key", "v", ranks)
    medians = answers.groupBy("key").agg(F.avg("answer").alias("value"))
    return sizes.join(medians, sizes["key"].eqNullSafe(medians["key"]), "left").select(
        sizes["key"].alias(group), "value"
    )
