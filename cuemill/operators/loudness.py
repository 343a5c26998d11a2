"""Loudness measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ["input_i", "input_tp", "input_lra", "input_thresh", "target_offset"]


def read_loudness(logs: DataFrame) -> DataFrame:
    """Measurements from analyser logs (media_id, log): the last brace block, null if broken.

    Values are text in the log; "-inf" stands for silence.
    """
    # from the last opening to the last closing brace
    block = F.regexp_extract("log", r"(?s)\{[^{]*\}", 0)
    last = F.regexp_extract("log", r"(?s)(\{[^{]*\})[^{}]*$", 1)
    text = F.when(block == "", None).otherwise(F.nullif(last, F.lit("")))
    parsed = F.from_json(text, ", ".join(f"{f} string" for f in FIELDS))
    rows = logs.select("media_id", parsed.alias("m"))

    def number(name: str) -> Column:
        raw = F.trim(F.col("m")[name])
        infinite = F.lower(raw).isin("-inf", "-infinity")
        return F.when(infinite, F.lit(float("-inf"))).otherwise(raw.try_cast("double"))

    return rows.select("media_id", *[number(f).alias(f) for f in FIELDS])


def needs_boost(loudness: DataFrame, threshold: float = -24.0) -> DataFrame:
    """Mark audio quieter than the threshold; pure silence and unknown loudness are left alone."""
    level = F.col("input_i")
    quiet = (level < threshold) & (level != float("-inf"))
    return loudness.withColumn("needs_boost", F.coalesce(quiet, F.lit(False)))


def quality_report(loudness: DataFrame, threshold: float = -24.0) -> DataFrame:
    level = F.col("input_i")
    return needs_boost(loudness, threshold).agg(
        F.count("*").alias("items"),
        F.count(level).alias("analysed"),
        F.count_if("needs_boost").alias("boosted"),
        F.count_if(level == float("-inf")).alias("silent"),
    )
