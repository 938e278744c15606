"""Single-key equi joins of two tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.types import col, require_columns

KINDS = ("inner", "left", "right", "outer")


def join_datasets(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    how: str = "inner",
    suffixes: Sequence[str] = ("_x", "_y"),
) -> DataFrame:
    """Join on one key; null keys match each other, shared names get suffixes.

    A key with the same name on both sides appears once. No strategy is forced: Spark
    broadcasts a side its statistics prove small and otherwise sort-merges, where AQE splits a
    hot key. AQE cannot split a full outer join, so that one runs as a left join plus the
    right rows nobody matched, and both of those can be split.
    """
    how = (how or "inner").lower()
    if how not in KINDS:
        raise ValueError(f"unknown join '{how}'; one of {', '.join(KINDS)}")
    if len(suffixes) != 2:
        raise ValueError("suffixes are two texts")
    require_columns(left, [left_on])
    require_columns(right, [right_on])
    if how == "outer":
        matched = join_datasets(left, right, left_on, right_on, "left", suffixes)
        lone = _select(left.limit(0), _unmatched(left, right, left_on, right_on), left_on, right_on, "right", suffixes)
        return matched.unionByName(lone)
    return _select(left, right, left_on, right_on, how, suffixes)


def _unmatched(left: DataFrame, right: DataFrame, left_on: str, right_on: str) -> DataFrame:
    keys = left.select(col(left_on).alias("__key")).distinct()
    return right.join(keys, col(right_on).eqNullSafe(F.col("__key")), "left_anti")


def _select(
    left: DataFrame, right: DataFrame, left_on: str, right_on: str, how: str, suffixes: Sequence[str]
) -> DataFrame:
    same_key = left_on == right_on
    shared = set(left.columns) & set(right.columns) - ({left_on} if same_key else set())
    lhs = left.select(*[col(c).alias(f"__l{i}") for i, c in enumerate(left.columns)])
    rhs = right.select(*[col(c).alias(f"__r{i}") for i, c in enumerate(right.columns)])
    lk, rk = F.col(f"__l{left.columns.index(left_on)}"), F.col(f"__r{right.columns.index(right_on)}")
    joined = lhs.join(rhs, lk.eqNullSafe(rk), how)
    out = []
    for i, c in enumerate(left.columns):
        source = (rk if how == "right" else lk) if same_key and c == left_on else F.col(f"__l{i}")
        out.append(source.alias(c + suffixes[0] if c in shared else c))
    for i, c in enumerate(right.columns):
        if not (same_key and c == right_on):
            out.append(F.col(f"__r{i}").alias(c + suffixes[1] if c in shared else c))
    return joined.select(*out)


def output_names(
    left: Sequence[str], right: Sequence[str], same_keys: set[str], suffixes: Sequence[str]
) -> tuple[list[str], list[str | None]]:
    """Names of both sides' columns in a result: shared ones get suffixes, the right copy of a shared key is None."""
    if len(suffixes) != 2:
        raise ValueError("suffixes are two texts")
    shared = set(left) & set(right) - same_keys
    names = lambda columns, end: [c + end if c in shared else c for c in columns]
    return names(left, suffixes[0]), [None if c in same_keys else n for c, n in zip(right, names(right, suffixes[1]))]


def join_summary(left: DataFrame, right: DataFrame, joined: DataFrame) -> DataFrame:
    """One row ``(left_rows, right_rows, result_rows)``."""
    tagged = [t.select(F.lit(i).alias("side")) for i, t in enumerate((left, right, joined))]
    sides = tagged[0].unionAll(tagged[1]).unionAll(tagged[2])
    names = ("left_rows", "right_rows", "result_rows")
    return sides.agg(*[F.count_if(F.col("side") == i).alias(n) for i, n in enumerate(names)])
