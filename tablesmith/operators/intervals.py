"""Joins of intervals (or points) that overlap, by bins of several widths."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.operators.asof import position
from tablesmith.operators.joins import output_names
from tablesmith.session import broadcast_if_small, durable
from tablesmith.types import col, require_columns

RATIO = 8  # each level's bins are so many times as wide as those of the level below
HOT_ROWS = 20_000  # left rows of a bin beyond which it is split
POINTS = 200  # points a bin should hold where only points are joined
SLICE_ROWS = 1_000_000  # distinct places of a slice when overlaps are only counted


def interval_join(
    left: DataFrame,
    right: DataFrame,
    left_on: str | tuple[str, str],
    right_on: str | tuple[str, str],
    by: Sequence[str | tuple[str, str]] = (),
    closed: bool = True,
    how: str = "inner",
    suffixes: Sequence[str] = ("_x", "_y"),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """All pairs of rows whose intervals overlap and whose ``by`` columns are equal.

    A side is given by its start and end columns or by one column of points. With ``closed`` intervals
    hold both ends, else only their start (a point is always held). An interval that ends before it
    starts, or is empty, overlaps nothing, nor do null ends, NaN and null keys; ends may be infinite.
    ``how="left"`` keeps left rows without a partner.

    Bins of level 0 are as wide as the median interval, those of each further level ``RATIO`` times
    wider. An interval lives on the level whose bins are at least as wide as it is long, so it lies in
    two bins at most, and also visits the higher levels on which the other side has intervals. A pair
    meets on the higher of its two levels, and there only in the bin of its later start, so it is found
    exactly once without a step that removes doubles. Bins of more than ``hot_rows`` left rows are split
    into parts, each of which meets all right rows of the bin.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is 'inner' or 'left'")
    sides = [(on, on) if isinstance(on, str) else tuple(on) for on in (left_on, right_on)]
    pairs = [(b, b) if isinstance(b, str) else tuple(b) for b in by]
    require_columns(left, [*sides[0], *(a for a, _ in pairs)])
    require_columns(right, [*sides[1], *(b for _, b in pairs)])
    keys = [f"k{i}" for i in range(len(pairs))]
    tables, own = [], [[f"{s}{i}" for i in range(len(df.columns))] for s, df in (("a", left), ("b", right))]
    for df, (lo, hi), names, to in ((left, sides[0], [a for a, _ in pairs], own[0]), (right, sides[1], [b for _, b in pairs], own[1])):
        row = [col(c).alias(n) for c, n in zip(df.columns, to)]
        t = df.select(*[col(n).alias(k) for n, k in zip(names, keys)], position(df, lo).alias("lo"), position(df, hi).alias("hi"), *row)
        tables.append(t.withColumn("id", F.monotonically_increasing_id()) if how == "left" and df is left else t)
    if how == "left":
        tables[0] = durable(tables[0])  # ids stay what they are if a task is run again
    whole = tables[0]
    tables = [t.where(_usable(keys, lo == hi or closed)) for t, (lo, hi) in zip(tables, sides)]

    low, high, width = _extent(tables)
    nobody = [F.lit(None).cast(f.dataType).alias(n) for f, n in zip(right.schema.fields, own[1])]
    name = lambda found: _named(found, own, left.columns, right.columns, {b for a, b in pairs if a == b}, suffixes)
    if low is None:
        return name((whole if how == "left" else whole.limit(0)).select(*own[0], *nobody))
    number = lambda c: F.least(F.greatest(F.col(c).cast("double"), F.lit(low)), F.lit(high))
    length = number("hi") - number("lo")
    level = F.greatest(F.ceil(F.log(float(RATIO), F.greatest(length / width, F.lit(1.0)))), F.lit(0)).cast("int")
    placed = [t.withColumns({"s": number("lo"), "e": number("hi"), "home": level}) for t in tables]
    homes = [sorted(r.home for r in t.select("home").distinct().collect()) for t in placed]  # a few dozen at most
    bins = [_listed(t, width, homes[1 - i]) for i, t in enumerate(placed)]

    at = [*keys, "level", "bin"]
    crowd = bins[0].groupBy(*at).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows)
    parts = broadcast_if_small(crowd.select(*at, F.ceil(F.col("n") / hot_rows).cast("int").alias("parts")))
    spread = F.xxhash64(*[n for n, f in zip(own[0], left.schema.fields) if isinstance(f.dataType, T.AtomicType)])
    a = bins[0].join(parts, at, "left").withColumn("part", F.coalesce(F.pmod(spread, "parts").cast("int"), F.lit(0)))
    b = bins[1].join(parts, at, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))))
    b = b.select(*at, "part", *own[1], *[F.col(c).alias(f"r_{c}") for c in ("lo", "hi", "s", "home")])
    met = a.join(b, [*at, "part"])
    point_a, point_b = (lo == hi for lo, hi in sides)
    met = met.where(
        (F.col("level") == F.greatest("home", "r_home"))
        & (F.floor(F.greatest("s", "r_s") / F.pow(F.lit(float(RATIO)), "level") / width) == F.col("bin"))
        & _before(F.col("lo"), F.col("r_hi"), closed or point_b)
        & _before(F.col("r_lo"), F.col("hi"), closed or point_a)
    )
    found = met.select(*(["id"] if how == "left" else []), *own[0], *own[1])
    if how == "left":
        lone = whole.join(found.select("id").distinct(), "id", "left_anti").select(*own[0], *nobody)
        found = found.drop("id").unionAll(lone)
    return name(found)


def count_overlaps(
    left: DataFrame,
    right: DataFrame,
    left_on: str | tuple[str, str],
    right_on: str | tuple[str, str],
    by: Sequence[str | tuple[str, str]] = (),
    name: str = "n",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``left`` with the number of right rows that ``interval_join`` would pair each row with; ends are held.

    No pair is made: those that begin by an interval's end, less those that end before its start, overlap
    it. Both numbers are running sums over the distinct places of each key, kept in slices of about
    ``slice_rows`` places whose totals are carried along, so the work grows with the rows and not with the
    overlaps. Rows that overlap nothing, for null ends and keys too, have 0. A column called ``name`` is replaced.
    """
    sides = [(on, on) if isinstance(on, str) else tuple(on) for on in (left_on, right_on)]
    pairs = [(b, b) if isinstance(b, str) else tuple(b) for b in by]
    require_columns(left, [*sides[0], *(a for a, _ in pairs)])
    require_columns(right, [*sides[1], *(b for _, b in pairs)])
    keys = [f"k{i}" for i in range(len(pairs))]
    own = [c for c in left.columns if c != name]
    a = left.select(*[col(n).alias(k) for (n, _), k in zip(pairs, keys)], position(left, sides[0][0]).alias("lo"), position(left, sides[0][1]).alias("hi"), F.struct(*[col(c) for c in own]).alias("row"))
    b = right.select(*[col(n).alias(k) for (_, n), k in zip(pairs, keys)], position(right, sides[1][0]).alias("lo"), position(right, sides[1][1]).alias("hi")).where(_usable(keys, True))
    usable = _usable(keys, True)
    marks = [(b, "lo", 1, 0), (b, "hi", 0, 1), (a.where(usable), "lo", 0, 0), (a.where(usable), "hi", 0, 0)]
    placed = None
    for table, place, begins, ends in marks:
        each = table.select(*keys, F.col(place).alias("at"), F.lit(begins).alias("begins"), F.lit(ends).alias("ends"))
        placed = each if placed is None else placed.unionByName(each)
    placed = durable(placed.groupBy(*keys, "at").agg(F.sum("begins").alias("begins"), F.sum("ends").alias("ends")))

    sliced = placed.withColumn("slice", _slice_of(placed, slice_rows))
    so_far = Window.partitionBy(*keys, "slice").orderBy("at")
    upto, before = (so_far.rowsBetween(Window.unboundedPreceding, last) for last in (Window.currentRow, -1))
    earlier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy(*keys, "slice").agg(F.sum("begins").alias("begins"), F.sum("ends").alias("ends"))
    carried = totals.select(*keys, "slice", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("begins", "ends")])
    sums = sliced.select(*keys, "slice", "at", F.sum("begins").over(upto).alias("begun"), F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("ended"))
    sums = sums.join(carried, [*keys, "slice"]).select(*keys, "at", (F.col("begun") + F.col("begins_before")).alias("begun"), (F.col("ended") + F.col("ends_before")).alias("ended"))
    sums = durable(sums)

    begun = sums.select(*keys, F.col("at").alias("hi"), "begun")
    ended = sums.select(*keys, F.col("at").alias("lo"), "ended")
    met = a.where(usable).join(begun, [*keys, "hi"]).join(ended, [*keys, "lo"]).select("row", (F.col("begun") - F.col("ended")).alias(name))
    return met.unionAll(a.where(~usable).select("row", F.lit(0).cast("long"))).select(*[F.col("row")[c].alias(c) for c in own], name)


def _slice_of(placed: DataFrame, slice_rows: int) -> Column:
    """The slice of ``at``, between borders that are literals."""
    slices = math.ceil(placed.count() / slice_rows)
    if slices <= 1:
        return F.lit(0)
    shares = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    at = F.col("at").cast("double")
    borders = sorted(set(placed.agg(F.percentile_approx(at, shares, F.lit(10 * slices))).first()[0]))
    return F.size(F.filter(F.array(*[F.lit(x) for x in borders]), lambda x: x < at))


def _usable(keys: list[str], touching: bool) -> Column:
    """Rows whose interval holds something: no null or NaN, and an end that is not before the start."""
    ok = (F.col("lo") <= F.col("hi")) if touching else (F.col("lo") < F.col("hi"))
    for c in ("lo", "hi"):
        ok = ok & ~F.isnan(F.col(c).cast("double"))
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    return F.coalesce(ok, F.lit(False))


def _before(start: Column, end: Column, touching: bool) -> Column:
    return start <= end if touching else start < end


def _extent(tables: list[DataFrame]) -> tuple[float | None, float | None, float]:
    """Least and greatest finite place, and the width of the narrowest bins."""
    ends = [t.select(F.col(c).cast("double").alias("x"), F.lit(None).cast("double").alias("d")) for t in tables for c in ("lo", "hi")]
    ends += [t.select(F.lit(None).cast("double").alias("x"), (F.col("hi").cast("double") - F.col("lo").cast("double")).alias("d")) for t in tables]
    every = ends[0]
    for e in ends[1:]:
        every = every.unionAll(e)
    finite = F.when(F.abs("x") < math.inf, F.col("x"))
    middle = F.percentile_approx(F.when((F.col("d") > 0) & (F.col("d") < math.inf), F.col("d")), F.lit(0.5), F.lit(1000))
    low, high, width, n = every.agg(F.min(finite), F.max(finite), middle, F.count("x")).first()
    if not n:
        return None, None, 1.0
    low, high = (0.0, 0.0) if low is None else (low, high)
    if width is None:
        width = (high - low) / max(n / POINTS, 1)
    # bins are numbered in 64 bits
    return low, high, max(width, (abs(low) + abs(high)) / 2**60, 1e-300)


def _listed(table: DataFrame, width: float, others: list[int]) -> DataFrame:
    """The bins of each interval: on its own level, and on the higher ones where the other side lives."""
    levels = F.array_union(F.array("home"), F.filter(F.array(*[F.lit(x) for x in others]), lambda x: x > F.col("home")))
    each = table.withColumn("level", F.explode(levels))
    unit = F.pow(F.lit(float(RATIO)), "level")
    first, last = (F.floor(F.col(c) / unit / width) for c in ("s", "e"))
    return each.withColumn("bin", F.explode(F.sequence(first, last)))


def _named(found: DataFrame, own: list[list[str]], left: list[str], right: list[str], same: set[str], suffixes: Sequence[str]) -> DataFrame:
    names = output_names(left, right, same, suffixes)
    return found.select(*[F.col(c).alias(n) for side, to in zip(own, names) for c, n in zip(side, to) if n is not None])
