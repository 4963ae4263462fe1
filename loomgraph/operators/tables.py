"""Upserts, appends and change feeds over tables kept as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_nodes(current: DataFrame, updates: DataFrame, key: str = "id", order: tuple[str, ...] = ("ts", "event"), create_only: tuple[str, ...] = ()) -> DataFrame:
    """Rows of current and updates by key: of each column the last value given (nulls give none), of create_only the first.

    updates carries the columns `order`; current counts as older. Aggregates combine before the shuffle, so a hot key costs no more.
    """
    columns = [c for c in current.columns if c != key]
    old = current.select(key, *columns, F.lit(0).alias("__new"), *[F.lit(None).cast(updates.schema[o].dataType).alias(o) for o in order])
    new = updates.select(key, *[F.col(c) if c in updates.columns else F.lit(None).cast(current.schema[c].dataType).alias(c) for c in columns], F.lit(1).alias("__new"), *order)
    rank = F.struct("__new", *order)
    pick = [(F.min_by if c in create_only else F.max_by)(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in columns]
    return old.unionByName(new).groupBy(key).agg(*pick)


def merge_edges(edges: DataFrame, new: DataFrame, sources: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """edges with the new ones whose ends exist, each once."""
    if sources is not None:
        new = new.join(sources.select(F.col("id").alias("src_id")), "src_id", "left_semi")
    if targets is not None:
        new = new.join(targets.select(F.col("id").alias("dst_id")), "dst_id", "left_semi")
    return edges.select("src_id", "dst_id").unionByName(new.select("src_id", "dst_id")).distinct()


def with_presence(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs (src_id, dst_id) with linked: whether such an edge is there already."""
    there = edges.select(F.col("src_id").alias("__s"), F.col("dst_id").alias("__d")).distinct().withColumn("linked", F.lit(True))
    d = pairs.join(there, F.col("src_id").eqNullSafe(F.col("__s")) & F.col("dst_id").eqNullSafe(F.col("__d")), "left")
    return d.withColumn("linked", F.coalesce("linked", F.lit(False))).drop("__s", "__d")


def append_absent(table: DataFrame | None, batch: DataFrame, key: str = "id", order: Column | None = None) -> DataFrame:
    """The rows of batch to append: one for each key, the first by order, if the table has no such key."""
    first = F.min_by(F.struct(*batch.columns), order if order is not None else F.struct(*[c for c, t in batch.dtypes if "map" not in t and "variant" not in t]))
    once = batch.groupBy(F.col(key).alias("__key")).agg(first.alias("__row")).select("__row.*")
    return once if table is None else once.join(table.select(key), key, "left_anti")


def latest_by(df: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Last write wins: columns of the row with the greatest order, for each key."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__last")).select(*key, "__last.*")


def changes(before: DataFrame, after: DataFrame, *key: str) -> DataFrame:
    """created, updated and archived rows between two snapshots with the same columns, by key (id); archived: a column status became so."""
    key = key or ("id",)
    columns = [c for c in before.columns if c not in key]
    b, a = before.select(*key, F.struct(*columns).alias("b")), after.select(*key, F.struct(*columns).alias("a"))
    gone = (F.col("a.status") == "archived") & (F.col("b.status") != "archived") if "status" in columns else F.lit(False)
    kind = F.when(F.col("b").isNull(), "created").when(gone, "archived").when(~F.col("a").eqNullSafe(F.col("b")), "updated")
    return b.join(a, list(key), "full_outer").where(F.col("a").isNotNull()).select(*key, kind.alias("change"), "a.*").where(F.col("change").isNotNull())


def first_of_key(df: DataFrame, key: list[str], order: list[Column]) -> Column:
    """Whether a row is the first of its key in a batch."""
    return F.row_number().over(Window.partitionBy(*key).orderBy(*order)) == 1
