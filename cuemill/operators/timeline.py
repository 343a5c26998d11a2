"""Chunk plans and the media timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions.text import trimmed


def plan_chunks(media: DataFrame, max_ms: int = 1_500_000, overlap_ms: int = 2_500) -> DataFrame:
    """Equal slices of at most max_ms, each extended by an overlap; nothing for short media.

    The number of chunks grows with the duration, so a long item becomes many rows.
    """
    plan = (
        media.filter(F.col("duration_ms") > max_ms)
        .select("media_id", "duration_ms", F.ceil(F.col("duration_ms") / max_ms).alias("n"))
        .withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .withColumn("content_start_ms", F.expr("(i * duration_ms) div n"))
        .withColumn("content_end_ms", F.expr("((i + 1) * duration_ms) div n"))
        .withColumn("start_ms", F.greatest(F.lit(0), F.col("content_start_ms") - overlap_ms))
        .withColumn("end_ms", F.least("duration_ms", F.col("content_end_ms") + overlap_ms))
        .withColumn("has_start_overlap", (F.col("i") > 0) & (F.col("start_ms") > 0))
        .withColumn("has_end_overlap", (F.col("i") < F.col("n") - 1) & (F.col("end_ms") < F.col("duration_ms")))
    )
    overlaps = F.col("has_start_overlap") | F.col("has_end_overlap")
    return plan.select(
        "media_id",
        F.col("i").cast("int").alias("chunk_idx"),
        "start_ms",
        "end_ms",
        "content_start_ms",
        "content_end_ms",
        "has_start_overlap",
        "has_end_overlap",
        F.when(overlaps, overlap_ms).otherwise(0).cast("long").alias("overlap_ms"),
    )


def planned_overlap(chunks: DataFrame) -> DataFrame:
    """Overlap time planned per media, once per chunk."""
    return chunks.groupBy("media_id").agg(F.sum("overlap_ms").alias("overlap_ms"), F.count("*").alias("chunks"))


def shift_times(df: DataFrame, offset_ms: int | Column) -> DataFrame:
    """Move start, end and word times by an offset."""
    offset = offset_ms if isinstance(offset_ms, Column) else F.lit(offset_ms)
    df = df.withColumns({"start_ms": F.col("start_ms") + offset, "end_ms": F.col("end_ms") + offset})
    if "words" not in df.columns:
        return df
    moved = F.transform(
        "words",
        lambda w: w.withField("start_ms", w["start_ms"] + offset).withField("end_ms", w["end_ms"] + offset),
    )
    return df.withColumn("words", moved)


def fallback_offsets(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Offset of every chunk that has segments: its planned start, else the time reached so far.

    After a planned chunk the time reached is its planned end; after a chunk
    without a plan it grows by the end of its last segment. One row per chunk
    (tens of minutes of audio) goes into the window, not one per segment.
    """
    heard = segments.groupBy("media_id", "chunk_idx").agg(F.max_by("end_ms", "seg_idx").alias("heard_ms"))
    plan = chunks.select("media_id", "chunk_idx", F.col("start_ms").alias("plan_start"), F.col("end_ms").alias("plan_end"))
    rows = heard.join(plan, ["media_id", "chunk_idx"], "full")
    before = Window.partitionBy("media_id").orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, -1)
    # time gained since the last planned chunk: all gains so far minus those up to it
    gain = F.when(F.col("plan_end").isNull(), F.coalesce("heard_ms", F.lit(0))).otherwise(0)
    upto = Window.partitionBy("media_id").orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("gained", F.sum(gain).over(upto))
    anchor = F.when(F.col("plan_end").isNotNull(), F.struct("plan_end", "gained"))
    rows = (
        rows.withColumn("anchor", F.last(anchor, ignorenulls=True).over(before))
        .withColumn("reached", F.coalesce(F.sum(gain).over(before), F.lit(0)))
        .withColumn(
            "reached",
            F.when(F.col("anchor").isNull(), F.col("reached")).otherwise(
                F.col("anchor.plan_end") + F.col("reached") - F.col("anchor.gained")
            ),
        )
    )
    return rows.filter("heard_ms is not null").select(
        "media_id", "chunk_idx", F.coalesce("plan_start", "reached").alias("offset_ms")
    )


def to_media_timeline(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Turn times counted from a chunk's start into times of the media item."""
    offsets = fallback_offsets(segments, chunks)
    placed = segments.join(offsets, ["media_id", "chunk_idx"], "left")
    return shift_times(placed, F.coalesce("offset_ms", F.lit(0))).drop("offset_ms")


def regions_to_media_timeline(segments: DataFrame, regions: DataFrame) -> DataFrame:
    """Same for segments recognised per speech region; needs region_idx on both sides."""
    starts = regions.select("media_id", "region_idx", F.col("start_ms").alias("offset_ms"))
    placed = segments.join(starts, ["media_id", "region_idx"], "left")
    return shift_times(placed, F.coalesce("offset_ms", F.lit(0))).drop("offset_ms")


def primary_window(segments: DataFrame, chunks: DataFrame, tolerance_ms: int = 50) -> DataFrame:
    """Keep a segment only in the chunk that owns its midpoint; keep it if nothing is known."""
    owned = chunks.select("media_id", "chunk_idx", "content_start_ms", "content_end_ms")
    # twice the midpoint, to stay in integers
    middle = F.col("start_ms") + F.col("end_ms")
    inside = middle.between(
        (F.col("content_start_ms") - tolerance_ms) * 2, (F.col("content_end_ms") + tolerance_ms) * 2
    )
    return (
        segments.join(owned, ["media_id", "chunk_idx"], "left")
        .filter(F.coalesce(inside, F.lit(True)))
        .drop("content_start_ms", "content_end_ms")
    )


def drop_empty_text(df: DataFrame) -> DataFrame:
    return df.filter(trimmed(F.col("text")) != "")


def assemble_text(segments: DataFrame) -> DataFrame:
    """One text per media: non-empty segment texts in order, one space apart."""
    item = F.struct("seg_idx", trimmed(F.col("text")).alias("text"))
    rows = drop_empty_text(segments).groupBy("media_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return rows.select("media_id", F.array_join("items.text", " ").alias("text"))
