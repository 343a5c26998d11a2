"""Live run status, region merging, queue intake and segment cleaning."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cuemill.operators.cues import drop_degenerate
from cuemill.operators.timeline import drop_empty_text, primary_window


def run_status(run_log: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Status changes and their mean time per event-time window; needs a ts timestamp column."""
    counts = (
        run_log.withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("w"), "status")
        .agg(F.count("*").alias("changes"), F.avg("processing_s").alias("mean_s"))
    )
    return counts.select(F.col("w.start").alias("window_start"), "status", "changes", "mean_s")


def merge_regions(regions: DataFrame, max_gap_ms: int = 500, late: str = "1 hour") -> DataFrame:
    """Regions at most max_gap_ms apart as one, each sent once, when the watermark says that it is closed.

    A joined region ends where its last one ends, as in the batch operator. Regions
    wait in the state of their media item until the watermark has passed their start,
    and are then joined in order of start; the state holds what is waiting and one open
    region, however long the stream. Regions that come later than ``late``, and those
    without an item or a time, are left out.
    """
    rows = regions.select("media_id", "start_ms", "end_ms").dropna()
    rows = rows.withColumn("ts", F.timestamp_millis("start_ms")).withWatermark("ts", late)
    return rows.groupBy("media_id").applyInPandasWithState(
        partial(_joined_regions, max_gap_ms),
        "media_id long, start_ms long, end_ms long",
        "start_ms long, end_ms long, starts array<long>, ends array<long>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def _joined_regions(gap: int, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    start, end, starts, ends = state.get if state.exists else (None, None, [], [])
    waiting = list(zip(starts, ends))
    for batch in batches:
        waiting += zip(batch["start_ms"].tolist(), batch["end_ms"].tolist())
    waiting.sort()
    passed = state.getCurrentWatermarkMs()
    # rows that start at the watermark or before it are dropped from now on
    ready = bisect_right(waiting, (passed, float("inf")))
    closed = []
    for begin, finish in waiting[:ready]:
        if start is not None and begin - end > gap:
            closed.append((key[0], start, end))
            start = None
        start, end = begin if start is None else start, finish
    if start is not None and passed >= end + gap:
        closed.append((key[0], start, end))
        start = end = None
    waiting = waiting[ready:]
    if start is None and not waiting:
        state.remove()
    else:
        state.update((start, end, [w[0] for w in waiting], [w[1] for w in waiting]))
        due = [t for t in (None if start is None else end + gap, waiting[0][0] if waiting else None) if t is not None]
        state.setTimeoutTimestamp(max(min(due), passed + 1))
    if closed:
        yield pd.DataFrame(closed, columns=["media_id", "start_ms", "end_ms"])


def dedupe_queue(adds: DataFrame, late: str = "1 day") -> DataFrame:
    """First add of every path; needs a ts timestamp column."""
    return adds.withWatermark("ts", late).dropDuplicatesWithinWatermark(["path"])


def clean_segments(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Segments with text, owned by their chunk (a static table) and not noise; no state is kept."""
    return drop_degenerate(primary_window(drop_empty_text(segments), chunks))
