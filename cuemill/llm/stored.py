"""Tables written once to the shared folder and read back: a cut of lineage with known sizes and pruned columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from cuemill.session import shared_folder


def stored(df: DataFrame, *by: str) -> DataFrame:
    """The rows of ``df``, from parquet files that every executor can read; in folders of the columns ``by``."""
    folder = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(folder)
    kept = [f for f in df.schema if f.name not in by] + [df.schema[c] for c in by]
    return df.sparkSession.read.schema(type(df.schema)(kept)).parquet(folder)
