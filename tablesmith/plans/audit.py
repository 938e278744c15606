"""The audit frame: cleaning steps that leave one record per touched cell.

A step maps a column's value to struct(new, method, confidence, reason). Steps are chained as
projections over the same rows: the table carries its records in one array column, so any number
of row-local steps is one stage without a shuffle. Who asks for the data only never pays for the
records, because the optimizer drops the unused column.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.binding import let
from tablesmith.types import col

LOG = "__audit"
ENTRY = "array<struct<column:string,old_value:string,new_value:string,method:string,confidence:double,reason:string>>"


def entry(column: str, old: Column, new: Column, method: Column, confidence: Column, reason: Column) -> Column:
    return F.struct(
        F.lit(column).alias("column"),
        old.cast("string").alias("old_value"),
        new.cast("string").alias("new_value"),
        method.cast("string").alias("method"),
        confidence.cast("double").alias("confidence"),
        reason.cast("string").alias("reason"),
    )


def _cells(columns: list[str], ready: Mapping[str, str]) -> Column:
    def cell(c: str) -> Column:
        parts = [F.lit(c).alias("column"), col(c).alias("old")]
        return F.struct(*parts, F.col(ready[c]).alias("ready")) if ready else F.struct(*parts)

    return F.array(*[cell(c) for c in columns])


def _apply(fix: Callable[..., Column], prepared: bool) -> Callable[[Column], Column]:
    def run(x: Column) -> Column:
        old = x.getField("old")
        result = fix(old, x.getField("ready")) if prepared else let(old, fix)
        return F.struct(x.getField("column").alias("column"), old.alias("old"), result.alias("s"))

    return run


def _has_record(x: Column) -> Column:
    return x.getField("s").getField("method").isNotNull()


def _as_record(x: Column) -> Column:
    s = x.getField("s")
    return F.struct(
        x.getField("column").alias("column"),
        x.getField("old").cast("string").alias("old_value"),
        s.getField("new").cast("string").alias("new_value"),
        s.getField("method").alias("method"),
        s.getField("confidence").alias("confidence"),
        s.getField("reason").alias("reason"),
    )


@dataclass(frozen=True)
class Audited:
    """A table under cleaning: ``frame`` holds the data and the records since the last removal,
    ``earlier`` the records made before rows were removed."""

    frame: DataFrame
    row_id: str
    earlier: DataFrame | None = None
    halted: bool = False
    halt_reason: str = ""

    @classmethod
    def start(cls, df: DataFrame, row_id: str) -> Audited:
        return cls(df.withColumn(LOG, F.array().cast(ENTRY)), row_id)

    @property
    def data(self) -> DataFrame:
        return self.frame.drop(LOG)

    @property
    def audit(self) -> DataFrame:
        """``(row_id, column, old_value, new_value, method, confidence, reason)``."""
        # Outer inline plus a filter on its output: a plain inline makes the optimizer infer
        # size(log) > 0 and push it, with all repairs spelled out, below every projection.
        log = self.frame.select(col(self.row_id).alias("row_id"), F.inline_outer(LOG)).where("method IS NOT NULL")
        return log if self.earlier is None else self.earlier.unionByName(log)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.frame.columns if c not in (LOG, self.row_id)]

    def step(
        self, repairs: Mapping[str, Callable[..., Column]], prepare: Callable[[Column], Column] | None = None
    ) -> Audited:
        """Apply one repair per named column and append what it recorded.

        Columns that share a repair are gathered in one array and repaired by one lambda, so the
        plan grows with the number of repairs, not of columns. ``prepare`` computes, in a
        projection of its own, a second argument of the repairs.
        """
        if not repairs:
            return self
        groups: dict[Callable[..., Column], list[str]] = {}
        for c, fix in repairs.items():
            groups.setdefault(fix, []).append(c)
        frame = self.frame
        ready = {}
        if prepare is not None:
            ready = {c: f"__p{i}" for i, c in enumerate(repairs)}
            frame = frame.withColumns({p: prepare(col(c)) for c, p in ready.items()})

        staged, fresh, logs = {}, {}, [F.col(LOG)]
        for i, (fix, members) in enumerate(groups.items()):
            mark = f"__s{i}"
            staged[mark] = F.transform(_cells(members, ready), _apply(fix, bool(ready)))
            fresh |= {c: F.get(F.col(mark), F.lit(j)).getField("s").getField("new") for j, c in enumerate(members)}
            logs.append(F.transform(F.filter(F.col(mark), _has_record), _as_record).cast(ENTRY))
        out = frame.withColumns(staged).drop(*ready.values()).withColumns({LOG: F.concat(*logs), **fresh})
        return replace(self, frame=out.drop(*staged))

    def remove(self, kept: DataFrame, gone: DataFrame, what: str, method: str, reason: str) -> Audited:
        """Go on with the rows of ``kept``; ``gone`` holds the ids of the removed rows."""
        note = gone.select(
            col(self.row_id).alias("row_id"),
            F.lit("*all*").alias("column"),
            F.lit(f"({what})").alias("old_value"),
            F.lit("(removed)").alias("new_value"),
            F.lit(method).alias("method"),
            F.lit(1.0).alias("confidence"),
            F.lit(reason).alias("reason"),
        )
        emptied = kept.withColumn(LOG, F.array().cast(ENTRY))
        return replace(self, frame=emptied, earlier=self.audit.unionByName(note))


def audit_by_method(audit: DataFrame) -> DataFrame:
    """``(method, n)``: records per method."""
    return audit.groupBy("method").agg(F.count(F.lit(1)).alias("n"))


def cells_changed(audit: DataFrame) -> DataFrame:
    """One row ``(cells_changed)``: records whose new value differs from the old one."""
    differs = ~F.col("old_value").eqNullSafe(F.col("new_value"))
    return audit.agg(F.count_if(differs).alias("cells_changed"))
