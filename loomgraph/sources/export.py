"""Export and import of entities as JSON lines by type, with a manifest of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.lifecycle import apply_deleted
from loomgraph.operators.ranks import numbered


def select_export(entities: DataFrame, app: str | None = None, types: list[str] | None = None, include_deleted: bool = False) -> DataFrame:
    d = entities if include_deleted else apply_deleted(entities)
    if app:
        d = d.where(F.col("_owner") == app)
    return d.where(F.col("_type").isin(types)) if types else d


def manifest(entities: DataFrame) -> DataFrame:
    return entities.groupBy("_type").agg(F.count("*").alias("n"))


def export(entities: DataFrame, path: str) -> None:
    entities.write.mode("overwrite").partitionBy("_type").json(f"{path}/entities")
    manifest(entities).write.mode("overwrite").json(f"{path}/manifest")


def linked_documents(entities: DataFrame, context: str, order: str, size: int = 10_000) -> DataFrame:
    """(_type, part, document): each type's entities as JSON-LD documents of at most size entities, by ascending order (a unique column).

    A type of up to size entities has one document, part 0. Entities are numbered by ranges, so no row or task holds a whole type.
    Null fields are left out; entities may hold columns of any type.
    """
    columns = [c for c in entities.columns if c != "_type"]
    d = numbered(entities.select(F.struct(*columns).alias("entity"), "_type", F.col(order).alias("at")), ["_type"], ["at"])
    d = d.groupBy("_type", F.floor((F.col("n") - 1) / size).alias("part")).agg(F.array_sort(F.collect_list(F.struct("n", "entity")), lambda x, y: (x["n"] - y["n"]).cast("int")).alias("all"))
    document = F.struct(F.lit(context).alias("@context"), F.col("_type").alias("@type"), F.transform("all", lambda x: x["entity"]).alias("@graph"))
    return d.select("_type", "part", F.to_json(document).alias("document"))


def import_entities(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The entities, and the types whose count isn't the manifest's."""
    d = spark.read.schema(schema).json(f"{path}/entities")
    said = spark.read.schema("_type string, n bigint").json(f"{path}/manifest")
    found = manifest(d).select("_type", F.col("n").alias("found"))
    off = said.join(found, "_type", "full_outer").where(~F.col("n").eqNullSafe(F.col("found")))
    return d, off
