"""Views of activity by day, app and file; days are UTC."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scalars import basename, extension, micros_to_date, stem
from loomgraph.operators.ranks import numbered

DAY = 86_400_000_000


def since(files: DataFrame, now: int, days: int, inclusive: bool = False) -> DataFrame:
    edge = F.lit(now - days * DAY)
    return files.where(F.col("last_accessed") >= edge if inclusive else F.col("last_accessed") > edge)


def between(files: DataFrame, start: int, end: int) -> DataFrame:
    return files.where((F.col("last_accessed") >= start) & (F.col("last_accessed") < end))


def activity_dates(files: DataFrame, now: int, days: int = 90) -> DataFrame:
    return since(files, now, days).select(micros_to_date(F.col("last_accessed")).alias("date")).distinct()


def apps_by_date(files: DataFrame, accessed: DataFrame) -> DataFrame:
    a = accessed.select(F.col("src_id").alias("id"), F.col("dst_id").alias("app_id"))
    return files.select("id", "last_accessed").join(a, "id").select(micros_to_date(F.col("last_accessed")).alias("date"), "app_id").distinct()


def with_display_names(files: DataFrame, by: list[str]) -> DataFrame:
    """files with display: their basename in the listing `by`; later ones of a name, by path, get a number before the extension.

    Numbers come from ranges of names and paths, so one name of very many files is no task's work. Needs a shared folder.
    """
    d = numbered(files.where("path <> ''").withColumn("name", basename(F.col("path"))), [*by, "name"], ["path"])
    other = F.concat(stem(F.col("path")), F.lit("_"), F.col("n").cast("string"), extension(F.col("path")))
    return d.withColumn("display", F.when(F.col("n") == 1, F.col("name")).otherwise(other)).drop("n", "name")


def files_by_date_app(files: DataFrame, accessed: DataFrame) -> DataFrame:
    a = accessed.select(F.col("src_id").alias("id"), F.col("dst_id").alias("app"))
    d = files.select("id", "path", "last_accessed").join(a, "id").select(micros_to_date(F.col("last_accessed")).alias("date"), "app", "path").distinct()
    return with_display_names(d, ["date", "app"])


def last_days(files: DataFrame, now: int, days: int = 7) -> DataFrame:
    d = since(files, now, days, inclusive=True).select("path")
    return with_display_names(d.distinct(), [])
