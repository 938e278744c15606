"""As-of joins: each row with the nearest earlier or later row of another table."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.operators.joins import output_names
from tablesmith.operators.ordering import MAX_SLICES, SLICE_ROWS
from tablesmith.session import broadcast_if_small
from tablesmith.types import col, require_columns

DIRECTIONS = ("backward", "forward", "nearest")
_ATOMIC = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


def position(df: DataFrame, name: str) -> Column:
    """A numeric or date/time column as a number: microseconds for times."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.NumericType):
        return col(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(col(name).cast("timestamp"))
    raise ValueError(f"'{name}' must be numeric or a date/time")


def span(df: DataFrame, name: str, amount: float) -> float:
    """A distance along the column in the unit of ``position``: seconds for times."""
    return amount if isinstance(df.schema[name].dataType, T.NumericType) else round(amount * 1_000_000)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    by: Sequence[str | tuple[str, str]] = (),
    direction: str = "backward",
    tolerance: float | None = None,
    allow_exact: bool = True,
    how: str = "left",
    tie: str | None = None,
    suffixes: Sequence[str] = ("_x", "_y"),
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Each left row with the last right row at or before it (``backward``), the first at or after it
    (``forward``), or the closer of both (``nearest``, the earlier one at equal distance).

    ``by`` names columns that must be equal (a pair when their names differ). ``tolerance`` is the
    largest distance, in seconds for dates and times; ``allow_exact=False`` leaves out rows at the same
    place. Among right rows at one place the last by ``tie`` (without it: by all their columns) counts
    backward and the first forward. Null keys and null places match nothing; ``how="inner"`` drops left
    rows without a match. Names that both sides have get suffixes; keys of one name appear once.

    Both tables are laid into one order and a window carries the last right row on. A key of more than
    ``slice_rows`` rows is cut along the order, at places found by quantiles, and each slice gets from
    the earlier ones the single row that matters, so no window runs over a whole hot key.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction '{direction}'; one of {', '.join(DIRECTIONS)}")
    if how not in ("left", "inner"):
        raise ValueError("how is 'left' or 'inner'")
    if tolerance is not None and not tolerance >= 0:
        raise ValueError("tolerance is not negative")
    pairs = [(b, b) if isinstance(b, str) else tuple(b) for b in by]
    require_columns(left, [left_on, *(a for a, _ in pairs)])
    require_columns(right, [right_on, *(b for _, b in pairs), *([tie] if tie else [])])
    keys = [f"k{i}" for i in range(len(pairs))]
    own = F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(left.columns)]).alias("own")
    event = F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(right.columns)]).alias("event")
    usable = lambda names: [F.col(n).isNotNull() for n in names]

    at = "at"
    lhs = left.select(*[col(a).alias(k) for k, (a, _) in zip(keys, pairs)], position(left, left_on).alias(at), own)
    rhs = right.select(*[col(b).alias(k) for k, (_, b) in zip(keys, pairs)], position(right, right_on).alias(at), event)
    complete = F.lit(True)
    for c in usable([*keys, at]):
        complete = complete & c
    ties = [F.col("event")[f"c{right.columns.index(tie)}"]] if tie else []
    if not tie:
        ties = [F.col("event")[f"c{i}"] for i, f in enumerate(right.schema.fields) if isinstance(f.dataType, _ATOMIC)]
    rhs = rhs.where(complete).withColumn("tie", F.struct(*ties) if ties else F.struct(F.lit(0)))
    probes = lhs.where(complete).withColumns({"event": F.lit(None).cast(rhs.schema["event"].dataType), "tie": F.lit(None).cast(rhs.schema["tie"].dataType)})
    events = rhs.withColumn("own", F.lit(None).cast(lhs.schema["own"].dataType))
    wide = T.DoubleType() if isinstance(lhs.schema[at].dataType, T.FractionalType) or isinstance(rhs.schema[at].dataType, T.FractionalType) else T.LongType()
    if not isinstance(lhs.schema[at].dataType, T.DecimalType) or lhs.schema[at].dataType != rhs.schema[at].dataType:
        probes, events = (t.withColumn(at, F.col(at).cast(wide)) for t in (probes, events))
    both = probes.unionByName(events)

    sliced, cut = _sliced(both, keys, slice_rows)
    found = {}
    for way in ("backward", "forward"):
        if direction in (way, "nearest"):
            sliced = _carry(sliced, keys, cut, way, allow_exact)
            found[way] = F.col(way)
    matched = sliced.where(F.col("own").isNotNull())
    limit = None if tolerance is None else span(left, left_on, tolerance)
    picks = []
    for way, e in found.items():
        gap = F.col(at) - e[at] if way == "backward" else e[at] - F.col(at)
        near = e.isNotNull() if limit is None else e.isNotNull() & (gap <= F.lit(limit))
        picks.append((gap, F.when(near, e["event"])))
    match = picks[0][1]
    if direction == "nearest":
        (back, earlier), (ahead, later) = picks
        match = F.when(later.isNull() | (earlier.isNotNull() & (back <= ahead)), earlier).otherwise(later)
    out = matched.select("own", match.alias("event"))
    if how == "inner":
        out = out.where(F.col("event").isNotNull())
    else:
        out = out.unionAll(lhs.where(~complete | complete.isNull()).select("own", F.lit(None).cast(rhs.schema["event"].dataType)))
    names_left, names_right = output_names(left.columns, right.columns, {b for a, b in pairs if a == b}, suffixes)
    return out.select(
        *[F.col("own")[f"c{i}"].alias(n) for i, n in enumerate(names_left)],
        *[F.col("event")[f"c{i}"].alias(n) for i, n in enumerate(names_right) if n is not None],
    )


def _sliced(both: DataFrame, keys: list[str], slice_rows: int) -> tuple[DataFrame, bool]:
    """Add ``slice``: 0 for most keys, and along the order for those of too many rows; whether there are any."""
    heavy = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > slice_rows)
    rows = heavy.agg(F.sum("n")).first()[0]
    if not rows:
        return both.withColumn("slice", F.lit(0.0)), False
    marked = both.withColumn("hot", F.lit(True))
    if keys:
        hot = broadcast_if_small(heavy.select(*keys, F.lit(True).alias("hot")))
        marked = both.join(hot, keys, "left")
    n = min(MAX_SLICES, math.ceil(rows / slice_rows))
    shares = F.array(*[F.lit(i / n) for i in range(1, n)])
    place = F.when(F.col("hot"), F.col("at").cast("double"))
    borders = marked.agg(F.percentile_approx(place, shares, F.lit(max(10_000, 10 * n)))).first()[0] if n > 1 else []
    splits = [-math.inf, *sorted({b for b in borders if math.isfinite(b)}), math.inf]
    # literal borders: a task that is run again cuts at the same places
    cut = Bucketizer(splits=splits, inputCol="place", outputCol="slice", handleInvalid="keep")
    cold = F.col("hot").isNull()
    sliced = cut.transform(marked.withColumn("place", F.coalesce(place, F.lit(0.0))))
    return sliced.withColumn("slice", F.when(cold, F.lit(0.0)).otherwise(F.col("slice"))).drop("place", "hot"), len(splits) > 2


def _carry(sliced: DataFrame, keys: list[str], cut: bool, way: str, allow_exact: bool) -> DataFrame:
    """Add ``way``: the right row (with its place) that each row sees in that direction."""
    backward = way == "backward"
    is_probe = F.col("own").isNotNull()
    side = is_probe if allow_exact else ~is_probe  # who comes first at one place
    order = [F.col("at"), side, F.col("tie")] if backward else [F.col("at").desc(), side, F.col("tie").desc()]
    here = F.when(~is_probe, F.struct("at", "event"))
    so_far = W.partitionBy(*keys, "slice").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = sliced.withColumn(way, F.last(here, ignorenulls=True).over(so_far))
    if not cut:
        return out
    # one row for each key and slice: its last right row, handed on to the slices after it
    pick = F.max_by if backward else F.min_by
    ends = sliced.where(~is_probe).groupBy(*keys, "slice").agg(pick(F.struct("at", "event"), F.struct("at", "tie")).alias("end"))
    places = sliced.select(*keys, "slice").distinct().join(ends, [*keys, "slice"], "left")
    step = F.col("slice") if backward else F.col("slice").desc()
    before = W.partitionBy(*keys).orderBy(step).rowsBetween(W.unboundedPreceding, -1)
    carried = places.select(*keys, "slice", F.last("end", ignorenulls=True).over(before).alias("carried")).where(F.col("carried").isNotNull())
    joined = out.join(carried, [*keys, "slice"], "left")
    return joined.withColumn(way, F.coalesce(way, "carried")).drop("carried")
