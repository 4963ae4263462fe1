"""Counts that Spark takes while rows are written, without a pass of their own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def observed(rows: DataFrame, outcomes: list[str], column: str = "outcome") -> tuple[DataFrame, Observation]:
    """rows, and an observation that has, once they were written or read to their end, how many of them have each outcome."""
    seen = Observation(f"counters-{uuid.uuid4().hex}")
    return rows.observe(seen, *[F.count_if(F.col(column) == o).alias(o) for o in outcomes]), seen


def write_counted(rows: DataFrame, path: str, outcomes: list[str], column: str = "outcome") -> dict[str, int]:
    """Writes rows to a folder and returns the counters of that pass. What a task that was lost had counted is counted again by its successor only."""
    d, seen = observed(rows, outcomes, column)
    d.write.parquet(path)
    return dict(seen.get)


def as_rows(spark: SparkSession, counters: dict[str, int]) -> DataFrame:
    return spark.createDataFrame(sorted(counters.items()), "outcome string, n long")
