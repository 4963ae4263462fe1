"""Event sources: batch and streaming files, payload decoding, listings, imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.schemas import ENVELOPE, PAYLOADS


def read_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(ENVELOPE).format(fmt).load(path)


def stream_events(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(ENVELOPE).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def decode(events: DataFrame, event_type: str) -> tuple[DataFrame, DataFrame]:
    """Events of one type with their payload's columns, and those whose JSON payload can't be read."""
    d = events.where(F.col("type") == event_type)
    schema = PAYLOADS[event_type]
    d = d.withColumn("p", F.from_json("payload", schema, {"mode": "PERMISSIVE"}))
    bad = F.col("payload").isNotNull() & (F.try_parse_json("payload").isNull() | F.col("p").isNull())
    clash = {c: f"payload_{c}" for c in schema.names if c in events.columns}
    return d.where(~bad).select(*events.columns, *[F.col(f"p.{c}").alias(clash.get(c, c)) for c in schema.names]), d.where(bad).select(*events.columns)


def read_listing(spark: SparkSession, path: str, contents: bool = False) -> DataFrame:
    """(path, is_dir, content) from a table, or of files under a folder with their contents."""
    if not contents:
        return spark.read.parquet(path).select("path", "is_dir", "content")
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return d.select(F.regexp_replace("path", "^file:", "").alias("path"), F.lit(False).alias("is_dir"), F.decode("content", "UTF-8").alias("content"))
