"""The given tables seen as activity: event log, roots, entities; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment that views look back from.
NOW = 1_706_659_200_000_000
DAY = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as an envelope with the payload's columns beside it."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r'"k": (\d+)', 1).cast("bigint")
    kind = F.col("event_type")
    types = {"click": "file.opened", "view": "app.presence.set", "error": "app.presence.clear", "signup": "window.focused", "purchase": "app.timeline.record"}
    t = F.lit(None).cast("string")
    for old, new in types.items():
        t = F.when(kind == old, new).otherwise(t)
    e = e.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), t.alias("type"), F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.concat(F.lit("svc"), (F.col("user_id") % 3).cast("string")).alias("source"), F.col("user_id").alias("pid"), F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string")).alias("session_id"),
        (F.col("user_id") % 5).alias("uid"), k.alias("k"), "value",
    )
    path = F.when(F.col("k") % 97 == 0, "").otherwise(F.concat(F.lit("/k/"), F.col("k").cast("string")))
    app = F.when(F.col("pid") % 11 == 0, "").otherwise(F.concat(F.lit("app"), (F.col("pid") % 20).cast("string")))
    return e.withColumns({
        "path": path, "app_id": app, "window_title": F.concat(F.lit("w"), F.col("k").cast("string")), "activity": F.concat(F.lit("act"), (F.col("k") % 4).cast("string")),
        "subject": F.concat(F.lit("sub"), (F.col("k") % 9).cast("string")), "label": F.concat(F.lit("label"), (F.col("k") % 6).cast("string")), "record_type": F.concat(F.lit("rec"), (F.col("k") % 3).cast("string")),
        "started_at": F.when(F.col("k") % 2 == 0, F.col("timestamp") - 1000).otherwise(0), "ended_at": F.when(F.col("k") % 3 == 0, F.col("timestamp") + 1000).otherwise(0),
    })


E = r"""E AS (SELECT *, CASE WHEN k % 97 = 0 THEN '' ELSE '/k/' || k END AS path, CASE WHEN pid % 11 = 0 THEN '' ELSE 'app' || (pid % 20) END AS app_id, 'w' || k AS window_title,
 'act' || (k % 4) AS activity, 'sub' || (k % 9) AS subject, 'label' || (k % 6) AS label, 'rec' || (k % 3) AS record_type,
 CASE WHEN k % 2 = 0 THEN "timestamp" - 1000 ELSE 0 END AS started_at, CASE WHEN k % 3 = 0 THEN "timestamp" + 1000 ELSE 0 END AS ended_at
 FROM (SELECT printf('%012d', event_id) AS id, CASE event_type WHEN 'click' THEN 'file.opened' WHEN 'view' THEN 'app.presence.set' WHEN 'error' THEN 'app.presence.clear' WHEN 'signup' THEN 'window.focused' WHEN 'purchase' THEN 'app.timeline.record' END AS type,
 epoch_us(ts) AS "timestamp", 'svc' || (user_id % 3) AS source, user_id AS pid, 's' || (user_id % 7) AS session_id, user_id % 5 AS uid, CAST(regexp_extract(props, '"k": (\d+)', 1) AS BIGINT) AS k, value FROM events))"""
OPENED = """O AS (SELECT CASE WHEN path <> '' THEN path ELSE 'unknown:' || id END AS file, path, CASE WHEN app_id <> '' THEN app_id ELSE source || ':' || pid END AS app, source AS app_name, "timestamp" AS ts, id, session_id FROM E WHERE type = 'file.opened')"""
FOCUSED = """W AS (SELECT CASE WHEN app_id <> '' THEN app_id ELSE 'unknown' END AS app, session_id, "timestamp" AS ts, id FROM E WHERE type = 'window.focused')"""
FILES = """F AS (SELECT file AS id, arg_max(path, (ts, id)) AS path, arg_max(app, (ts, id)) AS app_id, max(ts) AS last_accessed FROM O GROUP BY file)"""
ACCESSED = "A AS (SELECT DISTINCT file AS src_id, app AS dst_id FROM O)"
ACTIVE = "S AS (SELECT DISTINCT app AS src_id, session_id AS dst_id FROM W)"


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects whose root paths are nested as text, /k/1 and /k/12 and so on: one for each k above 0 that the log holds."""
    k = activity(spark, sf_dir).select("k").distinct().where("k > 0")
    pid = F.concat(F.lit("p"), F.lpad(F.col("k").cast("string"), 3, "0"))
    return k.select(pid.alias("project_id"), F.concat(F.lit("/k/"), F.col("k").cast("string")).alias("root_path"), (F.col("k") % 2 == 0).alias("inferred"), "k")


ROOTS = "R AS (SELECT DISTINCT 'p' || printf('%03d', k) AS project_id, '/k/' || k AS root_path, k % 2 = 0 AS inferred, k FROM E WHERE k > 0)"


def workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects as `roots` names them, but one for each part, so that their number grows with the tables."""
    p, k = table(spark, sf_dir, "part").where("p_partkey > 0"), F.col("p_partkey")
    return p.select(F.concat(F.lit("p"), k.cast("string")).alias("project_id"), F.concat(F.lit("/k/"), k.cast("string")).alias("root_path"), (k % 2 == 0).alias("inferred"), k.alias("k"))


WORKSPACES = "R AS (SELECT 'p' || p_partkey AS project_id, '/k/' || p_partkey AS root_path, p_partkey % 2 = 0 AS inferred, p_partkey AS k FROM part WHERE p_partkey > 0)"
NEAREST = """N AS (SELECT path, project_id, root_path FROM (SELECT p.path, R.project_id, R.root_path, row_number() OVER (PARTITION BY p.path ORDER BY length(R.root_path) DESC) AS n FROM (SELECT DISTINCT path FROM F) p JOIN R ON starts_with(p.path, R.root_path)) WHERE n = 1)"""
PART_OF = "L AS (SELECT F.id AS src_id, N.project_id AS dst_id FROM F JOIN N ON F.path = N.path WHERE F.path <> '')"


def sql(*ctes: str, select: str) -> str:
    return "WITH " + ", ".join(ctes) + " " + select


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entities of type Person."""
    c = table(spark, sf_dir, "customer")
    day = F.timestamp_micros(F.lit(NOW) - (F.col("c_custkey") % 90) * DAY)
    return c.select(
        F.col("c_custkey").alias("id"), F.lit("Person").alias("_type"), F.col("c_mktsegment").alias("_owner"), (F.col("c_custkey") % 4 + 1).cast("bigint").alias("_version"), (F.col("c_acctbal") < 0).alias("_deleted"),
        F.when(F.col("c_acctbal") < 0, day).alias("_deleted_at"), day.alias("_modified_at"), (F.col("c_custkey") % 17 == 0).alias("_pending_delete"), F.when(F.col("c_custkey") % 17 == 0, day).alias("_pending_delete_at"),
        F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"),
    )


PEOPLE = f"""P AS (SELECT c_custkey AS id, 'Person' AS _type, c_mktsegment AS _owner, CAST(c_custkey % 4 + 1 AS BIGINT) AS _version, c_acctbal < 0 AS _deleted,
 CASE WHEN c_acctbal < 0 THEN {NOW} - (c_custkey % 90) * {DAY} END AS deleted_us, c_custkey % 17 = 0 AS _pending_delete, CASE WHEN c_custkey % 17 = 0 THEN {NOW} - (c_custkey % 90) * {DAY} END AS pending_us, c_name AS name, c_nationkey AS nation FROM customer)"""
