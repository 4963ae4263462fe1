"""Schema migrations: operations on tables, chains of versions, resumable runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scalars import apply_transform
from loomgraph.schemas import FIELD_TYPES

#: An edge table by relation name.
Relations = dict[str, DataFrame]


def apply_operation(df: DataFrame, op: dict) -> DataFrame:
    """One operation on an entity's table. Index operations change nothing here: pruning by statistics needs none."""
    kind, f = op["op"], op.get("field", "")
    if kind == "add_field":
        value = F.col(op["populate_from"]) if op.get("populate_from") else F.lit(op.get("default"))
        return df.withColumn(f, value.cast(FIELD_TYPES.get(op["type"], "string")))
    if kind == "remove_field":
        return df.drop(f)
    if kind == "rename_field":
        return df.withColumnRenamed(op["from"], op["to"])
    if kind == "change_type":
        c = apply_transform(op["transform"], F.col(f)) if op.get("transform") else F.col(f)
        return df.withColumn(f, c.try_cast(FIELD_TYPES[op["type"]]))
    if kind == "rename_entity":
        return df.withColumn("_type", F.when(F.col("_type") == op["from"], op["to"]).otherwise(F.col("_type")))
    if kind == "custom":
        return df.sparkSession.sql(op["query"], entity=df)
    if kind in ("add_index", "remove_index", "add_relation", "remove_relation"):
        return df
    raise ValueError(f"unknown operation {kind}")


def apply_relations(relations: Relations, op: dict, empty: Callable[[], DataFrame]) -> Relations:
    if op["op"] == "add_relation":
        return {op["relation"]: empty(), **relations}
    if op["op"] == "remove_relation":
        return {k: v for k, v in relations.items() if k != op["relation"]}
    return relations


def migrate(df: DataFrame, ops: list[dict]) -> DataFrame:
    for op in ops:
        df = apply_operation(df, op)
    return df


def rejected(df: DataFrame, ops: list[dict]) -> DataFrame:
    """(id, field) of rows whose value a change of type could not take."""
    out = None
    for op in ops:
        if op["op"] == "change_type":
            c = F.col(op["field"])
            new = (apply_transform(op["transform"], c) if op.get("transform") else c).try_cast(FIELD_TYPES[op["type"]])
            bad = df.where(c.isNotNull() & new.isNull())
            part = bad.select("id", F.lit(op["field"]).alias("field"))
            out = part if out is None else out.unionByName(part)
        df = apply_operation(df, op)
    return out if out is not None else df.select("id", F.lit("").alias("field")).limit(0)


def chain(steps: DataFrame, start: str, target: str, most: int = 64) -> DataFrame:
    """(n, from_version, to_version) of the fewest steps (from_version, to_version) from start to target; empty if there is no way.

    A frontier of reached versions joins the steps once a round; each version keeps its first, smallest way.
    """
    spark = steps.sparkSession
    seen = spark.createDataFrame([(start, [start])], "version string, way array<string>")
    frontier = seen
    for _ in range(most):
        if not seen.where(F.col("version") == target).isEmpty():
            break
        d = frontier.join(steps, frontier.version == steps.from_version).select(F.col("to_version").alias("version"), F.concat("way", F.array("to_version")).alias("way"))
        frontier = d.groupBy("version").agg(F.min("way").alias("way")).join(seen.select("version"), "version", "left_anti").checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    way = seen.where((F.col("version") == target) & (F.size("way") > 1)).select(F.posexplode("way").alias("n", "from_version"), "way")
    return way.where(F.col("n") < F.size("way") - 1).select((F.col("n") + 1).alias("n"), "from_version", F.get("way", F.col("n") + 1).alias("to_version"))


def run_pending(table: str, ops: list[dict], control: str, read: Callable[[str], DataFrame]) -> DataFrame:
    """Runs each operation into a table version of its own and notes it in the control table; a rerun goes on after the last one noted."""
    df = read(table)
    spark = df.sparkSession
    try:
        done = spark.read.parquet(control).agg(F.max("done")).first()[0] or 0
    except Exception as e:  # no control table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = 0
    for k, op in enumerate(ops[done:], done + 1):
        src = table if k == 1 else f"{table}-v{k - 1}"
        apply_operation(read(src), op).write.mode("overwrite").parquet(f"{table}-v{k}")
        spark.createDataFrame([(k, op["op"])], "done int, op string").write.mode("append").parquet(control)
    return read(f"{table}-v{len(ops)}" if ops else table)
