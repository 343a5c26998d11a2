"""Reports over the run log: one row per status change of a media item.

All of them are partial aggregates, so a media item with most of the log costs
no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_status(run_log: DataFrame) -> DataFrame:
    """Current state of every media item."""
    state = F.struct("ts_ms", "event_id", "status", "processing_s", "error")
    latest = run_log.groupBy("media_id").agg(F.max_by(state, F.struct("ts_ms", "event_id")).alias("s"))
    return latest.select("media_id", "s.*")


def queue_status(run_log: DataFrame) -> DataFrame:
    """Items by status; position of the running item in the queue."""
    state = F.col("status")
    done = F.count_if(state.isin("completed", "failed"))
    return latest_status(run_log).agg(
        F.count_if(state == "queued").alias("queued"),
        F.count_if(state == "processing").alias("processing"),
        F.count_if(state == "completed").alias("completed"),
        F.count_if(state == "failed").alias("failed"),
        F.least(done + 1, F.count("*")).alias("position"),
        F.count("*").alias("total"),
    )


def batch_summary(run_log: DataFrame) -> DataFrame:
    """Completed and failed items, total and mean time of the completed ones."""
    good = F.col("status") == "completed"
    cents = F.round(F.col("processing_s") * 100).cast("long")
    return latest_status(run_log).agg(
        F.count_if(good).alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        (F.coalesce(F.sum(F.when(good, cents)), F.lit(0)) / 100).alias("total_s"),
        (F.coalesce(F.avg(F.when(good, cents)), F.lit(0.0)) / 100).alias("mean_s"),
    )


def first_failures(run_log: DataFrame, shown: int = 5) -> DataFrame:
    """The first failed items, with how many more there are."""
    failed = latest_status(run_log).filter("status = 'failed'")
    count = failed.agg(F.greatest(F.count("*") - shown, F.lit(0)).alias("more"))
    top = failed.orderBy("media_id").limit(shown)
    return top.select("media_id", F.coalesce("error", F.lit("Unknown error")).alias("error")).crossJoin(F.broadcast(count))


def eta(run_log: DataFrame, now_ms: int | Column) -> DataFrame:
    """Seconds left: mean time per queued item plus the rest of the running one; null if not positive."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    state = latest_status(run_log)
    good = F.col("status") == "completed"
    cents = F.round(F.col("processing_s") * 100).cast("long")
    totals = state.agg(
        (F.avg(F.when(good, cents)) / 100).alias("mean_s"),
        F.count_if(F.col("status") == "queued").alias("queued"),
        F.max(F.when(F.col("status") == "processing", F.col("ts_ms"))).alias("since_ms"),
    )
    elapsed = (now - F.col("since_ms")) / 1000
    mean = F.coalesce("mean_s", elapsed)
    left = mean * F.col("queued") + (mean - elapsed)
    return totals.select(F.when(left > 0, left).alias("remaining_s"))


def stage_timings(runs: DataFrame, stages: list[str]) -> DataFrame:
    """Mean, longest and median time of every stage of the runs.

    The median is a time that occurred, of a rank at most one in 10,000 of the runs
    from the middle one; it comes from summaries of bounded size.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(f"timings.{s}").alias("s")) for s in stages]))
    rows = runs.select(pairs.alias("t")).select("t.*")
    return rows.groupBy("stage").agg(
        F.count("s").alias("runs"), F.avg("s").alias("mean_s"), F.max("s").alias("max_s"),
        F.approx_percentile("s", 0.5, 10_000).alias("median_s"),
    )


def dedupe_queue(adds: DataFrame) -> DataFrame:
    """First arrival (arrival, path, …) of every path."""
    others = [c for c in adds.columns if c != "path"]
    first = adds.groupBy("path").agg(F.min(F.struct("arrival", *[c for c in others if c != "arrival"])).alias("f"))
    return first.select("path", *[F.col("f")[c].alias(c) for c in others])


def next_queued(run_log: DataFrame) -> DataFrame:
    """The queued item that has waited longest."""
    waiting = latest_status(run_log).filter("status = 'queued'")
    return waiting.agg(F.min(F.struct("ts_ms", "media_id")).alias("n")).filter("n is not null").select(
        F.col("n.media_id").alias("media_id"), F.col("n.ts_ms").alias("ts_ms")
    )
