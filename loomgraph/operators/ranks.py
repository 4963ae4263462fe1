"""Numbering of ordered rows without a task that holds a whole key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.checkpoints import ensure


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "n", parts: int | None = None) -> DataFrame:
    """df with the long column `name`: each row's place, from 1, among the rows of its key `by` in ascending order (nulls first).

    Rows are dealt by ranges of (by, order), so a key with many rows lies in many parts, one behind the other. A row's place is the one
    that it has in its part plus the key's rows in all parts before: a running sum over one row for each part and key. The dealt rows
    are written to the shared folder first, so that a lost executor can't deal them anew. Rows that are equal in by and order are
    numbered in any order; columns of df are kept as they are.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"))
    keys = [F.col(f"row.{c}").alias(f"b{i}") for i, c in enumerate(by)]
    sort = [F.col(f"row.{c}").alias(f"o{i}") for i, c in enumerate(order)]
    d = d.select("row", *keys, *sort)
    names = [f"b{i}" for i in range(len(by))]
    ranged = [*names, *[f"o{i}" for i in range(len(order))]]
    d = d.repartitionByRange(parts, *ranged).sortWithinPartitions(*ranged)
    # monotonically_increasing_id: the part in the upper 31 bits, the place in it in the lower 33
    path = f"{ensure(spark).rstrip('/')}/numbered-{uuid.uuid4().hex}"
    d.select("row", *names, F.monotonically_increasing_id().alias("at")).write.parquet(path)
    d = spark.read.parquet(path).withColumn("part", F.shiftright("at", 33))
    counts = d.groupBy("part", *names).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy(*[F.col(c) for c in names]).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("part", *[F.col(c).alias(f"c_{c}") for c in names], "first", before.alias("before"))
    on = [d["part"] == counts["part"], *[d[c].eqNullSafe(counts[f"c_{c}"]) for c in names]]
    return d.join(counts, on).select("row.*", (F.col("at") - F.col("first") + F.col("before") + 1).alias(name))
