"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` written, and evaluated, once.

    An expression that names its input many times, chained with others like it, would multiply:
    the optimizer could spell the whole product out in one method too large to compile.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
