"""Bounded samples of labelled transcripts for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEPS = 1 << 30


def draw(rows: DataFrame, share: Column) -> DataFrame:
    """About ``share`` of the rows, by a hash of media_id: the same rows in every run, spread over all of them."""
    return rows.filter(F.pmod(F.xxhash64(F.lit(17), "media_id"), F.lit(_STEPS)) < share * _STEPS)


def bounded(rows: DataFrame, limit: int, weight: Column | None = None) -> DataFrame:
    """Rows whose number (or summed ``weight``) is ``limit`` on average, or all of them if that is less."""
    total = rows.agg(F.sum(F.lit(1) if weight is None else weight).alias("n")).first()["n"] or 0
    return rows if total <= limit else draw(rows, F.lit(limit / total))
