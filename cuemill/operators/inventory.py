"""Media listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File types taken as media.
SUFFIXES = [".mp4", ".avi", ".mkv", ".mov", ".webm", ".mp3"]


def suffix_of(path):
    """Last suffix of the file name, in lower case."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Listing of a folder tree: path and size, without reading any content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("size_bytes"), F.lit(True).alias("exists"))


def media_inventory(listing: DataFrame) -> DataFrame:
    """Media files of a listing, by path in any case."""
    media = listing.withColumn("suffix", suffix_of(F.col("path"))).filter(F.col("suffix").isin(*SUFFIXES))
    return media.orderBy(F.lower("path"), "path")


def folder_of(path):
    return F.regexp_replace(path, r"/[^/]*$", "")


def folders_above(folder):
    """A folder and all that it lies in, down from the first named one."""
    parts = F.split(folder, "/")
    prefixes = F.transform(parts, lambda part, k: F.struct(part.alias("last"), F.array_join(F.slice(parts, 1, k + 1), "/").alias("folder")))
    named = F.filter(prefixes, lambda p: (p["last"] != "") & ~p["last"].endswith(":"))
    return F.transform(named, lambda p: p["folder"])


def folders_without_media(listing: DataFrame) -> DataFrame:
    """Folders of a listing that hold no media file themselves, also those that hold only folders."""
    direct = listing.select(folder_of(F.col("path")).alias("folder")).distinct()
    folders = direct.select(F.explode(folders_above(F.col("folder"))).alias("folder")).distinct()
    media = listing.filter(suffix_of(F.col("path")).isin(*SUFFIXES))
    return folders.join(media.select(folder_of(F.col("path")).alias("folder")).distinct(), "folder", "left_anti")


def validate_media(listing: DataFrame) -> DataFrame:
    """Verdict on every file; the first failing test gives it."""
    suffix = F.regexp_extract("path", r"[^/](\.[^./]+)$", 1)
    verdict = (
        F.when(~F.lower(suffix).isin(*SUFFIXES), F.concat(F.lit("Unsupported format: "), suffix))
        .when(~F.col("exists"), "File does not exist")
        .when(F.col("size_bytes") == 0, "File is empty")
        .otherwise("File is valid")
    )
    return listing.withColumn("verdict", verdict)


def verdict_counts(listing: DataFrame) -> DataFrame:
    return validate_media(listing).groupBy("verdict").agg(F.count("*").alias("files"))
