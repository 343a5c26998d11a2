"""Array helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: inside a lambda an outer expression runs per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def indexes(n: Column) -> Column:
    """0 .. n-1, empty for n = 0."""
    return F.slice(F.sequence(F.lit(0), n.cast("int")), F.lit(1), n.cast("int"))
