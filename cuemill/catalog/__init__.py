"""Named queries over the driver's tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuemill.catalog.sql import with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, recursive: bool = False):
    """Register a query under its function's name."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = with_tables(sql, recursive)
        return function

    return add


def load() -> None:
    from cuemill.catalog import (  # noqa: F401
        caption_queries,
        region_queries,
        run_queries,
        segment_queries,
        source_queries,
        stream_queries,
        text_queries,
        timeline_queries,
        translation_queries,
    )
