"""Folding of events into nodes and edges; every fold takes rows in any order."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.scalars import uuid5
from loomgraph.operators.tables import latest_by

#: Fixed value: the namespace of annotations' ids.
ANNOTATIONS = uuid.UUID("6eed7305-c483-4d73-a686-c1734db1297e")
#: Microseconds of a slice of one app's presence events that is put in order at a time.
SLICE = 3_600_000_000


def of_type(events: DataFrame, *types: str) -> DataFrame:
    return events.where(F.col("type").isin(*types))


def _or(c: str, other: Column) -> Column:
    return F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).otherwise(other)


def opened(events: DataFrame) -> DataFrame:
    """(file, path, app, app_name, ts, id, session_id) of file.opened events; missing paths and apps get names from the event."""
    return of_type(events, "file.opened").select(
        _or("path", F.concat(F.lit("unknown:"), F.col("id"))).alias("file"), F.coalesce("path", F.lit("")).alias("path"),
        _or("app_id", F.concat_ws(":", "source", F.col("pid").cast("string"))).alias("app"), F.col("source").alias("app_name"),
        F.col("timestamp").alias("ts"), "id", "session_id",
    )


def focused(events: DataFrame) -> DataFrame:
    return of_type(events, "window.focused").select(_or("app_id", F.lit("unknown")).alias("app"), "session_id", F.col("timestamp").alias("ts"), "id", F.col("window_title").alias("title"))


def fold_files(events: DataFrame) -> DataFrame:
    d = opened(events).select(F.col("file").alias("id"), "path", F.col("app").alias("app_id"), F.col("ts").alias("last_accessed"), "ts", F.col("id").alias("event"))
    return latest_by(d, ["id"], ["ts", "event"], ["path", "app_id", "last_accessed"])


def fold_apps(events: DataFrame) -> DataFrame:
    """Both kinds of event name apps; the later one wins."""
    a = opened(events).select(F.col("app").alias("id"), F.col("app_name").alias("name"), "ts", F.col("id").alias("event"))
    b = focused(events).select(F.col("app").alias("id"), F.col("app").alias("name"), "ts", F.col("id").alias("event"))
    return latest_by(a.unionByName(b), ["id"], ["ts", "event"], ["name"])


def fold_sessions(events: DataFrame, started: str = "last") -> DataFrame:
    """started: the time of a session's last focus, or with 'first' of its first."""
    pick = F.max if started == "last" else F.min
    return focused(events).where("session_id is not null").groupBy(F.col("session_id").alias("id")).agg(pick("ts").alias("started_at"))


def fold_window_events(events: DataFrame) -> DataFrame:
    return focused(events).select("id", F.lit("window.focused").alias("type"), F.col("ts").alias("timestamp"), F.lit("wayland").alias("source"), "title").dropDuplicates(["id"])


def accessed_by(events: DataFrame) -> DataFrame:
    return opened(events).select(F.col("file").alias("src_id"), F.col("app").alias("dst_id")).distinct()


def active_in(events: DataFrame) -> DataFrame:
    return focused(events).select(F.col("app").alias("src_id"), F.col("session_id").alias("dst_id")).where("dst_id is not null").distinct()


def user_actions(events: DataFrame) -> DataFrame:
    """Presence and timeline records as actions, keyed by their event."""
    at = F.coalesce(F.nullif("ended_at", F.lit(0)), F.nullif("started_at", F.lit(0)), F.col("timestamp"))
    kind = F.col("type")
    d = of_type(events, "app.presence.set", "app.presence.clear", "app.timeline.record").select(
        "id",
        F.when(kind == "app.timeline.record", "timeline").otherwise("presence").alias("category"),
        F.when(kind == "app.presence.set", F.col("activity")).when(kind == "app.presence.clear", "clear").otherwise(F.col("record_type")).alias("action"),
        F.when(kind == "app.presence.set", F.col("subject")).when(kind == "app.presence.clear", F.col("app_id")).otherwise(F.col("label")).alias("subject"),
        F.when(kind == "app.timeline.record", at).otherwise(F.col("timestamp")).alias("timestamp"),
    )
    return d.dropDuplicates(["id"])


def presence_intervals(events: DataFrame) -> DataFrame:
    """(app_id, activity, subject, start, end): each set lasts to the app's next set or clear; open ones have no end.

    An app's events are put in order by slices of time; a slice's last one ends where the app's next slice begins.
    """
    d = of_type(events, "app.presence.set", "app.presence.clear").withColumn("slice", F.floor(F.col("timestamp") / SLICE))
    first = d.groupBy("app_id", "slice").agg(F.min("timestamp").alias("first"))
    after = first.select("app_id", "slice", F.lead("first").over(Window.partitionBy("app_id").orderBy("slice")).alias("after"))
    w = Window.partitionBy("app_id", "slice").orderBy("timestamp", "id")
    d = d.withColumn("end", F.lead("timestamp").over(w)).join(after.withColumnRenamed("app_id", "__app"), F.col("app_id").eqNullSafe(F.col("__app")) & (d["slice"] == after["slice"]), "left")
    d = d.withColumn("end", F.coalesce("end", "after"))
    return d.where("type = 'app.presence.set'").select("app_id", "activity", "subject", F.col("timestamp").alias("start"), "end")


def annotation_state(events: DataFrame, namespace: uuid.UUID = ANNOTATIONS) -> DataFrame:
    """Annotations that stand: the last data since the key's last clear, created when that began.

    One aggregate finds each key's last clear, a join drops what came before it, another folds the rest: no key is sorted in one task.
    """
    key = ["target_type", "target_id", "namespace"]
    d = of_type(events, "app.annotation.set", "app.annotation.cleared").withColumn("at", F.struct("timestamp", "id"))
    cleared = d.where("type = 'app.annotation.cleared'").groupBy(*key).agg(F.max("at").alias("cleared"))
    live = d.where("type = 'app.annotation.set'").join(cleared, key, "left").where("cleared is null or at > cleared")
    out = live.groupBy(*key).agg(F.max_by("data_json", "at").alias("data"), F.min("timestamp").alias("created_at"), F.max("timestamp").alias("last_modified"))
    return out.select(uuid5(namespace, *[F.col(k) for k in key]).alias("id"), *key, "data", "created_at", "last_modified")


def link_files(files: DataFrame, ancestors: DataFrame) -> DataFrame:
    """FILE_PART_OF edges of files (id, path) by nearest ancestors (path, project_id); empty paths have none."""
    return files.where("path <> ''").join(ancestors, "path").select(F.col("id").alias("src_id"), F.col("project_id").alias("dst_id")).distinct()


def session_file_counts(part_of: DataFrame, accessed: DataFrame, active: DataFrame) -> DataFrame:
    """Distinct files of each project touched by an app active in each session."""
    p = part_of.select(F.col("src_id").alias("file"), F.col("dst_id").alias("project_id"))
    a = accessed.select(F.col("src_id").alias("file"), F.col("dst_id").alias("app"))
    s = active.select(F.col("src_id").alias("app"), F.col("dst_id").alias("session_id"))
    return p.join(a, "file").join(s, "app").groupBy("project_id", "session_id").agg(F.countDistinct("file").alias("files"))


def promote(projects: DataFrame, counts: DataFrame, threshold: int = 3) -> DataFrame:
    """projects, with inferred ones promoted that any session touched in enough files."""
    crossed = counts.where(F.col("files") >= threshold).select(F.col("project_id").alias("id")).distinct().withColumn("crossed", F.lit(True))
    done = F.col("promoted") | (F.col("inferred") & F.coalesce("crossed", F.lit(False)))
    return projects.join(crossed, "id", "left").withColumn("promoted", done).drop("crossed")


def classify_control(events: DataFrame, exact: dict[str, str], families: dict[str, str]) -> DataFrame:
    """events with control (a kind by exact type or by family prefix, else null) and the app meant: the payload's, the source, or unknown."""
    kind = F.lit(None).cast("string")
    for prefix, name in families.items():
        kind = F.when(F.col("type").startswith(prefix), name).otherwise(kind)
    for t, name in exact.items():
        kind = F.when(F.col("type") == t, name).otherwise(kind)
    return events.withColumn("control", kind).withColumn("app", _or("app_id", _or("source", F.lit("unknown"))))


def subscribed(events: DataFrame, patterns: list[str], uid: int = 0) -> DataFrame:
    """Events that a subscriber's patterns (exact, `family.*`, `*`) and uid (0: all users) let through."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | (F.lit(True) if p == "*" else F.col("type").startswith(p[:-1]) if p.endswith(".*") else F.col("type") == p)
    return events.where(hit & ((F.col("uid") == 0) | (F.lit(uid) == 0) | (F.col("uid") == uid)))


def annotations_of(annotations: DataFrame, targets: DataFrame) -> DataFrame:
    """Annotations of a table of targets (target_type, target_id and, for one app's only, namespace)."""
    return annotations.join(targets.distinct(), [c for c in ("target_type", "target_id", "namespace") if c in targets.columns], "left_semi")
