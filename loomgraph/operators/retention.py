"""Purging of the raw log and compaction of old files into summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = 86_400_000_000


def purge_cutoff(now: int, high_water: int, days: int = 30) -> int:
    return min(now - days * DAY, high_water)


def purge(events: DataFrame, cutoff: int) -> DataFrame:
    """What stays of the log: events from the cutoff on; all if there is none."""
    return events if cutoff <= 0 else events.where(F.col("timestamp") >= cutoff)


def old_files(files: DataFrame, pins: DataFrame, cutoff: int) -> DataFrame:
    """Files last accessed before the cutoff that nobody pinned."""
    pinned = pins.where("node_type = 'File'").select(F.col("node_id").alias("id"))
    return files.where(F.col("last_accessed") < cutoff).join(pinned, "id", "left_anti")


def compact(files: DataFrame, accessed: DataFrame, pins: DataFrame, cutoff: int, mode: str = "first_app") -> DataFrame:
    """Summary rows of old files by app. A file of several apps counts with the first by id, or with mode 'all_apps' with each."""
    use = old_files(files, pins, cutoff).select("id", "last_accessed").join(accessed.select(F.col("src_id").alias("id"), F.col("dst_id").alias("app_id")), "id")
    if mode == "first_app":
        use = use.groupBy("id").agg(F.min("app_id").alias("app_id"), F.max("last_accessed").alias("last_accessed"))
    g = use.groupBy("app_id").agg(F.count("*").alias("access_count"), F.min("last_accessed").alias("active_period_start"), F.max("last_accessed").alias("active_period_end"))
    return g.select(F.concat_ws(":", F.lit("summary"), "app_id", F.lit(str(cutoff))).alias("id"), F.lit("app").alias("type"), "app_id", "access_count", F.col("app_id").alias("primary_application"), "active_period_start", "active_period_end")


def survivors(files: DataFrame, accessed: DataFrame, pins: DataFrame, cutoff: int) -> DataFrame:
    """Files that compaction leaves: recent, pinned, or without an app to sum them under."""
    gone = old_files(files, pins, cutoff).join(accessed.select(F.col("src_id").alias("id")), "id", "left_semi").select("id")
    return files.join(gone, "id", "left_anti")


def drop_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """edges without those at either end of a removed node."""
    return edges.join(gone.select(F.col("id").alias("src_id")), "src_id", "left_anti").join(gone.select(F.col("id").alias("dst_id")), "dst_id", "left_anti")
