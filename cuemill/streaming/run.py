"""Running a stream over all rows present now, with a table as its result."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.session import shared_folder


def run_available(stream: DataFrame, mode: str = "append", keys: Sequence[str] = ()) -> DataFrame:
    """Process what is there and read the result back.

    In update mode each batch adds the rows it changed, and the last one of every
    key (``keys``) counts: the watermark frees state, and a batch that is run
    again replaces what it wrote. In complete mode each batch replaces the
    result, so open windows are in it too; all of its state is kept.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    out = f"{folder}/out"
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(out)
    elif mode == "update":
        query = writer.foreachBatch(
            lambda rows, batch: rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        ).start()
    else:
        query = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(out)
    rows = spark.read.parquet(out)
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*keys, "last.*").select(*stream.columns)
