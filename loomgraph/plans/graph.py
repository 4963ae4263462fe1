"""Driver queries over the event log and the graph folded from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import folds, paths, retention, tables, timeline
from loomgraph.plans.base import ACCESSED, ACTIVE, DAY, FILES, FOCUSED, NEAREST, NOW, OPENED, PART_OF, ROOTS, WORKSPACES, E, activity, roots, sql, table, workspaces
from loomgraph.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


@query(sql(E, OPENED, FILES, ACCESSED, select="SELECT F.path, A.dst_id AS app_id, F.last_accessed FROM F JOIN A ON F.id = A.src_id"))
def last_access(spark, sf):  # noqa: ANN001, ANN201
    """Last access of each file by each of its apps."""
    e = activity(spark, sf)
    a = folds.accessed_by(e).select(F.col("src_id").alias("id"), F.col("dst_id").alias("app"))
    return folds.fold_files(e).join(a, "id").select("path", F.col("app").alias("app_id"), "last_accessed").orderBy(F.desc("last_accessed"))


@query(sql(E, select='SELECT id, type, "timestamp" FROM E'))
def ingest_dedup(spark, sf):  # noqa: ANN001, ANN201
    """A batch with repeats, appended to a log that holds a part of it already."""
    e = activity(spark, sf).select("id", "type", "timestamp")
    old, again = e.where("cast(id as bigint) % 2 = 0"), e.where("cast(id as bigint) % 10 = 0")
    return old.unionByName(tables.append_absent(old, e.unionByName(again)))


@query(sql(E, OPENED, FILES, select="SELECT * FROM F"))
def fold_file_opened(spark, sf):  # noqa: ANN001, ANN201
    return folds.fold_files(activity(spark, sf))


@query(sql(E, FOCUSED, select="SELECT session_id AS id, max(ts) AS started_at FROM W GROUP BY 1"))
def fold_window_focused(spark, sf):  # noqa: ANN001, ANN201
    return folds.fold_sessions(activity(spark, sf))


@query(sql(E, OPENED, FOCUSED, select="SELECT id, arg_max(name, (ts, event)) AS name FROM (SELECT app AS id, app_name AS name, ts, id AS event FROM O UNION ALL SELECT app, app, ts, id FROM W) GROUP BY 1"))
def app_name_lww(spark, sf):  # noqa: ANN001, ANN201
    return folds.fold_apps(activity(spark, sf))


@query(sql(E, OPENED, ACCESSED, select="SELECT * FROM A"))
def edges_accessed_by(spark, sf):  # noqa: ANN001, ANN201
    e = activity(spark, sf)
    return tables.merge_edges(folds.accessed_by(e.where("uid = 0")), folds.accessed_by(e), folds.fold_files(e), folds.fold_apps(e))


@query(sql(E, FOCUSED, ACTIVE, select="SELECT * FROM S"))
def edges_active_in(spark, sf):  # noqa: ANN001, ANN201
    return folds.active_in(activity(spark, sf))


@query(sql(E, FOCUSED, select="SELECT id, 'window.focused' AS type, \"timestamp\", 'wayland' AS source, window_title AS title FROM E WHERE type = 'window.focused'"))
def window_events(spark, sf):  # noqa: ANN001, ANN201
    return folds.fold_window_events(activity(spark, sf))


@query(sql(E, OPENED, select="SELECT file AS id, arg_max(path, (ts, id)) AS path, arg_max(app, (ts, id)) AS app_id, min(ts) AS first_seen, max(ts) AS last_accessed FROM O GROUP BY 1"))
def node_upsert(spark, sf):  # noqa: ANN001, ANN201
    """Older half of the log as the table, newer half as its updates; first_seen is set once only."""
    o = folds.opened(activity(spark, sf)).select(F.col("file").alias("id"), "path", F.col("app").alias("app_id"), F.col("ts").alias("first_seen"), F.col("ts").alias("last_accessed"), "ts", F.col("id").alias("event"))
    half = NOW - 15 * DAY
    empty = o.select("id", "path", "app_id", "first_seen", "last_accessed").limit(0)
    old = tables.merge_nodes(empty, o.where(F.col("ts") < half), create_only=("first_seen",))
    return tables.merge_nodes(old, o.where(F.col("ts") >= half), create_only=("first_seen",))


@query(sql(E, select="""SELECT id, CASE WHEN type = 'app.timeline.record' THEN 'timeline' ELSE 'presence' END AS category,
 CASE type WHEN 'app.presence.set' THEN activity WHEN 'app.presence.clear' THEN 'clear' ELSE record_type END AS action,
 CASE type WHEN 'app.presence.set' THEN subject WHEN 'app.presence.clear' THEN app_id ELSE label END AS subject,
 CASE WHEN type = 'app.timeline.record' THEN coalesce(nullif(ended_at, 0), nullif(started_at, 0), "timestamp") ELSE "timestamp" END AS "timestamp"
 FROM E WHERE type IN ('app.presence.set', 'app.presence.clear', 'app.timeline.record')"""))  # fmt: skip
def user_actions(spark, sf):  # noqa: ANN001, ANN201
    return folds.user_actions(activity(spark, sf))


@query(sql(E, select="SELECT action, count(*) AS n FROM (SELECT CASE type WHEN 'app.presence.set' THEN activity ELSE 'clear' END AS action FROM E WHERE type IN ('app.presence.set', 'app.presence.clear')) GROUP BY 1"))
def presence_counts(spark, sf):  # noqa: ANN001, ANN201
    return folds.user_actions(activity(spark, sf)).where("category = 'presence'").groupBy("action").agg(F.count("*").alias("n"))


@query(sql(E, select="""SELECT app_id, activity, subject, "timestamp" AS start, "end" FROM (SELECT *, lead("timestamp") OVER (PARTITION BY app_id ORDER BY "timestamp", id) AS "end"
 FROM E WHERE type IN ('app.presence.set', 'app.presence.clear')) WHERE type = 'app.presence.set'"""))  # fmt: skip
def presence_intervals(spark, sf):  # noqa: ANN001, ANN201
    return folds.presence_intervals(activity(spark, sf))


ANNOTATED = """SELECT *, CASE WHEN type = 'app.presence.clear' THEN 1 ELSE 0 END AS clear, 'File' AS target_type, path AS target_id, app_id AS namespace, '{"v":' || k || '}' AS data FROM E WHERE type <> 'file.opened'"""


@query(sql(E, f"T AS ({ANNOTATED})", """G AS (SELECT *, sum(clear) OVER (PARTITION BY target_id, namespace ORDER BY "timestamp", id) AS seg FROM T)""",
           "M AS (SELECT *, max(seg) OVER (PARTITION BY target_id, namespace) AS last FROM G)",
           """H AS (SELECT target_type, target_id, namespace, arg_max(data, ("timestamp", id)) AS data, min("timestamp") AS created_at, max("timestamp") AS last_modified,
 sha1(unhex('6eed7305c4834d73a686c1734db1297e') || encode(target_type || chr(31) || target_id || chr(31) || namespace)) AS h FROM M WHERE seg = last AND clear = 0 GROUP BY 1, 2, 3)""",
           select="""SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', strpos('0123456789abcdef', substr(h, 17, 1)) % 4 + CASE WHEN strpos('0123456789abcdef', substr(h, 17, 1)) % 4 = 0 THEN 4 ELSE 0 END, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id,
 target_type, target_id, namespace, data, created_at, last_modified FROM H"""))  # fmt: skip
def annotation_state(spark, sf):  # noqa: ANN001, ANN201
    return folds.annotation_state(annotated(activity(spark, sf)))


def annotated(events: DataFrame) -> DataFrame:
    """All events but opened files as annotations of files, set or cleared."""
    e = events.where("type <> 'file.opened'")
    kind = F.when(F.col("type") == "app.presence.clear", "app.annotation.cleared").otherwise("app.annotation.set")
    data = F.concat(F.lit('{"v":'), F.col("k").cast("string"), F.lit("}"))
    return e.withColumns({"type": kind, "target_type": F.lit("File"), "target_id": F.col("path"), "namespace": F.col("app_id"), "data_json": data})


@query(f"SELECT id, target_id, namespace, data FROM ({SQL['annotation_state']}) WHERE target_id LIKE '/k/%7' OR (target_id LIKE '/k/%3' AND namespace = 'app3')")
def annotation_lookup(spark, sf):  # noqa: ANN001, ANN201
    a = annotation_state(spark, sf)
    t = a.select("target_type", "target_id", "namespace")
    every, one = folds.annotations_of(a, t.where("target_id like '/k/%7'").select("target_type", "target_id")), folds.annotations_of(a, t.where("target_id like '/k/%3' and namespace = 'app3'"))
    return every.unionByName(one).select("id", "target_id", "namespace", "data")


@query(sql(E, select="""SELECT type, CASE WHEN type = 'window.focused' THEN 'focus' WHEN type LIKE 'app.presence.%' THEN 'presence' END AS control, CASE WHEN app_id <> '' THEN app_id ELSE source END AS app, count(*) AS n FROM E GROUP BY 1, 2, 3"""))
def route_counts(spark, sf):  # noqa: ANN001, ANN201
    d = folds.classify_control(activity(spark, sf), {"window.focused": "focus"}, {"app.presence.": "presence"})
    return d.groupBy("type", "control", "app").agg(F.count("*").alias("n"))


@query(sql(E, select="SELECT id, type, uid FROM E WHERE (type LIKE 'app.presence.%' OR type = 'file.opened') AND (uid = 0 OR uid = 3)"))
def subscription_filter(spark, sf):  # noqa: ANN001, ANN201
    return folds.subscribed(activity(spark, sf), ["app.presence.*", "file.opened"], 3).select("id", "type", "uid")


@query(sql(E, select=f'SELECT id, "timestamp" FROM E WHERE "timestamp" > {NOW - 20 * DAY}'))
def incremental_range(spark, sf):  # noqa: ANN001, ANN201
    return streams.drop_late(activity(spark, sf).select("id", "timestamp"), NOW - 20 * DAY)


def _graph(spark, sf):  # noqa: ANN001, ANN202
    e = activity(spark, sf)
    files, near = folds.fold_files(e), None
    near = paths.nearest_ancestor(files.where("path <> ''"), roots(spark, sf))
    return e, files, folds.link_files(files, near), near


@query(sql(E, OPENED, FILES, ROOTS, NEAREST, select="SELECT * FROM N"))
def nearest_ancestor(spark, sf):  # noqa: ANN001, ANN201
    return _graph(spark, sf)[3]


@query("""WITH R AS (SELECT DISTINCT regexp_extract(url, '^(https?://[^/]*)', 1) AS root FROM pages UNION SELECT DISTINCT regexp_extract(url, '^(https?://[^/]*/[a-z]+)', 1) FROM pages)
 SELECT url AS path, root AS project_id, root AS root_path FROM (SELECT p.url, R.root, row_number() OVER (PARTITION BY p.url ORDER BY length(R.root) DESC) AS n FROM (SELECT DISTINCT url FROM pages) p JOIN R ON length(R.root) > 0 AND starts_with(p.url, R.root)) WHERE n = 1""")
def nearest_ancestor_urls(spark, sf):  # noqa: ANN001, ANN201
    p = table(spark, sf, "pages").select("url")
    r = p.select(F.explode(F.array(F.regexp_extract("url", "^(https?://[^/]*)", 1), F.regexp_extract("url", "^(https?://[^/]*/[a-z]+)", 1))).alias("root_path")).distinct()
    return paths.nearest_ancestor(p.select(F.col("url").alias("path")), r.withColumn("project_id", F.col("root_path")))


STOOD = f"RS AS (SELECT project_id, root_path, {NOW} - (k % 29) * {DAY} AS created_at, CASE WHEN k % 5 <> 0 THEN {NOW} - (k % 29) * {DAY} + (k % 9) * {DAY} + 1 END AS archived_at FROM R)"


@query(sql(E, OPENED, ROOTS, STOOD, select="""SELECT path, seen, project_id, root_path FROM (SELECT p.path, p.seen, RS.project_id, RS.root_path, row_number() OVER (PARTITION BY p.path, p.seen ORDER BY length(RS.root_path) DESC, RS.project_id DESC) AS n
 FROM (SELECT DISTINCT path, ts AS seen FROM O) p JOIN RS ON starts_with(p.path, RS.root_path) AND p.seen BETWEEN RS.created_at AND coalesce(RS.archived_at, p.seen)) WHERE n = 1"""))  # fmt: skip
def linked_as_of(spark, sf):  # noqa: ANN001, ANN201
    """Each opening of a file with the nearest project that stood at its time."""
    start = F.lit(NOW) - (F.col("k") % 29) * DAY
    r = roots(spark, sf).select("project_id", "root_path", start.alias("created_at"), F.when(F.col("k") % 5 != 0, start + (F.col("k") % 9) * DAY + 1).alias("archived_at"))
    return paths.nearest_as_of(folds.opened(activity(spark, sf)).select("path", F.col("ts").alias("at")), r).withColumnRenamed("at", "seen")


COUNTS = "C AS (SELECT L.dst_id AS project_id, S.dst_id AS session_id, count(DISTINCT L.src_id) AS files FROM L JOIN A ON L.src_id = A.src_id JOIN S ON A.dst_id = S.src_id GROUP BY 1, 2)"


@query(sql(E, OPENED, FOCUSED, FILES, ACCESSED, ACTIVE, ROOTS, NEAREST, PART_OF, COUNTS, select="SELECT * FROM C"))
def session_file_counts(spark, sf):  # noqa: ANN001, ANN201
    e, _, part_of, _ = _graph(spark, sf)
    return folds.session_file_counts(part_of, folds.accessed_by(e), folds.active_in(e))


@query(sql(E, OPENED, FOCUSED, FILES, ACCESSED, ACTIVE, ROOTS, NEAREST, PART_OF, COUNTS, select="SELECT project_id AS id, inferred, inferred AND EXISTS (SELECT 1 FROM C WHERE C.project_id = R.project_id AND files >= 3) AS promoted FROM R"))
def promoted_projects(spark, sf):  # noqa: ANN001, ANN201
    p = roots(spark, sf).select(F.col("project_id").alias("id"), "inferred", F.lit(False).alias("promoted"))
    return folds.promote(p, session_file_counts(spark, sf))


@query(sql(E, OPENED, FOCUSED, FILES, ACCESSED, ACTIVE, ROOTS, NEAREST, PART_OF, select="SELECT DISTINCT L.dst_id AS n0, L.src_id AS n1, A.dst_id AS n2, S.dst_id AS n3 FROM L JOIN A ON L.src_id = A.src_id JOIN S ON A.dst_id = S.src_id"))
def path_pattern(spark, sf):  # noqa: ANN001, ANN201
    e, _, part_of, _ = _graph(spark, sf)
    return paths.match_path([(part_of, "in"), (folds.accessed_by(e), "out"), (folds.active_in(e), "out")])


@query(sql(E, OPENED, FILES, ROOTS, NEAREST, PART_OF, select="SELECT src_id, dst_id, ends_with(src_id, '7') AS linked FROM L"))
def links_present(spark, sf):  # noqa: ANN001, ANN201
    """New links of files to projects, and whether each is among the edges already."""
    part_of = _graph(spark, sf)[2]
    return tables.with_presence(part_of, part_of.where("src_id like '%7'"))


@query(sql(E, OPENED, FILES, ROOTS, NEAREST, PART_OF, select="SELECT L.dst_id AS project_id, F.id, F.path FROM L JOIN F ON L.src_id = F.id"))
def project_files(spark, sf):  # noqa: ANN001, ANN201
    _, files, part_of, _ = _graph(spark, sf)
    return part_of.select(F.col("src_id").alias("id"), F.col("dst_id").alias("project_id")).join(files, "id").select("project_id", "id", "path")


@query(sql(E, OPENED, FILES, ROOTS, NEAREST, PART_OF, select="SELECT L.dst_id AS project_id, max(F.last_accessed) AS last_accessed FROM L JOIN F ON L.src_id = F.id GROUP BY 1"))
def last_access_by_project(spark, sf):  # noqa: ANN001, ANN201
    _, files, part_of, _ = _graph(spark, sf)
    return part_of.select(F.col("src_id").alias("id"), F.col("dst_id").alias("project_id")).join(files, "id").groupBy("project_id").agg(F.max("last_accessed").alias("last_accessed"))


@query(sql(E, OPENED, FILES, select=f"SELECT DISTINCT strftime(make_timestamp(last_accessed), '%Y-%m-%d') AS date FROM F WHERE last_accessed > {NOW - 90 * DAY}"))
def timeline_dates(spark, sf):  # noqa: ANN001, ANN201
    return timeline.activity_dates(folds.fold_files(activity(spark, sf)), NOW)


@query(sql(E, OPENED, FILES, ACCESSED, select="SELECT DISTINCT strftime(make_timestamp(F.last_accessed), '%Y-%m-%d') AS date, A.dst_id AS app_id FROM F JOIN A ON F.id = A.src_id"))
def timeline_apps_by_date(spark, sf):  # noqa: ANN001, ANN201
    e = activity(spark, sf)
    return timeline.apps_by_date(folds.fold_files(e), folds.accessed_by(e))


@query(sql(E, OPENED, "D AS (SELECT DISTINCT strftime(make_timestamp(ts), '%Y-%m-%d') AS date, app, path || '/' || session_id || '/notes.v1.md' AS path FROM O WHERE path <> '')",
           "M AS (SELECT *, row_number() OVER (PARTITION BY date, app ORDER BY path) AS n FROM D)", select="SELECT date, app, path, CASE WHEN n = 1 THEN 'notes.v1.md' ELSE 'notes.v1_' || n || '.md' END AS display FROM M"))
def timeline_files_by_date_app(spark, sf):  # noqa: ANN001, ANN201
    o = folds.opened(activity(spark, sf)).where("path <> ''")
    path = F.concat_ws("/", "path", "session_id", F.lit("notes.v1.md"))
    files = o.select(F.col("id"), path.alias("path"), F.col("ts").alias("last_accessed"))
    return timeline.files_by_date_app(files, o.select(F.col("id").alias("src_id"), F.col("app").alias("dst_id")))


@query(sql(E, OPENED, FILES, select=f"SELECT path, regexp_extract(path, '([^/]*)$', 1) AS display FROM F WHERE path <> '' AND last_accessed >= {NOW - 7 * DAY}"))
def last_7_days(spark, sf):  # noqa: ANN001, ANN201
    return timeline.last_days(folds.fold_files(activity(spark, sf)), NOW)


@query(sql(E, OPENED, FILES, select=f"SELECT id, last_accessed FROM F WHERE last_accessed >= {NOW - 20 * DAY} AND last_accessed < {NOW - DAY}"))
def files_between(spark, sf):  # noqa: ANN001, ANN201
    return timeline.between(folds.fold_files(activity(spark, sf)), NOW - 20 * DAY, NOW - DAY).select("id", "last_accessed")


HOSTS = "U AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/]*)', 1) AS host, regexp_replace(url, '^https?:/', '') AS path FROM pages)"


@query(sql(HOSTS, "G AS (SELECT host, min(path) AS lo, max(path) AS hi, count(DISTINCT path) AS n FROM U GROUP BY 1)",
           "S AS (SELECT host, CASE WHEN n = 1 THEN lo ELSE (SELECT coalesce(max(substr(lo, 1, CAST(i AS BIGINT))), '') FROM generate_series(1, least(length(lo), length(hi))) t(i) WHERE substr(lo, 1, CAST(i AS BIGINT)) = substr(hi, 1, CAST(i AS BIGINT))) END AS shared FROM G)",
           select="SELECT host, regexp_extract(shared, '^(.*)/', 1) AS directory FROM S"))
def common_dir(spark, sf):  # noqa: ANN001, ANN201
    p = table(spark, sf, "pages").select(F.regexp_extract("url", "^https?://([^/]*)", 1).alias("host"), F.regexp_replace("url", "^https?:/", "").alias("path"))
    return paths.directory_of_all(p, ["host"])


TREE = "T AS (SELECT project_id, root_path, substr(root_path, 4) AS relative FROM (SELECT project_id, '/k/' || substr(root_path, 4) || '/src/lib' || (k % 3) AS root_path, k FROM R))"


def _tree(spark, sf):  # noqa: ANN001, ANN202
    r = workspaces(spark, sf)
    deep = F.concat(F.col("root_path"), F.lit("/src/lib"), (F.col("k") % 3).cast("string"))
    return paths.project_tree(r.select("project_id", deep.alias("root_path"), F.col("project_id").alias("name")))


@query(sql(WORKSPACES, TREE, select="SELECT project_id, root_path, relative FROM T"))
def project_tree(spark, sf):  # noqa: ANN001, ANN201
    return _tree(spark, sf).select("project_id", "root_path", "relative")


@query(sql(WORKSPACES, TREE, "Q AS (SELECT relative, string_split(relative, '/') AS p FROM T)", select="""SELECT DISTINCT array_to_string(p[1:i - 1], '/') AS prefix, CASE WHEN i = len(p) THEN 'leaf' ELSE 'dir' END AS kind, p[i] AS name
 FROM (SELECT p, unnest(generate_series(1, len(p))) AS i FROM Q)"""))  # fmt: skip
def tree_children(spark, sf):  # noqa: ANN001, ANN201
    return paths.tree_children(_tree(spark, sf))


@query(sql(E, select=f'SELECT id, "timestamp" FROM E WHERE "timestamp" >= least({NOW - 20 * DAY}, (SELECT max("timestamp") FROM E))'))
def raw_purge(spark, sf):  # noqa: ANN001, ANN201
    e = activity(spark, sf).select("id", "timestamp")
    high = e.agg(F.max("timestamp")).first()[0] or 0
    return retention.purge(e, retention.purge_cutoff(NOW, high, 20))


CUT = NOW - 3 * DAY
PINS = "Z AS (SELECT id FROM F WHERE CAST(regexp_extract(id, '(\\d+)$', 1) AS BIGINT) % 10 = 0)"


def _pins(files):  # noqa: ANN001, ANN202
    return files.where(F.regexp_extract("id", r"(\d+)$", 1).cast("bigint") % 10 == 0).select(F.col("id").alias("node_id"), F.lit("File").alias("node_type"))


@query(sql(E, OPENED, FILES, ACCESSED, PINS, f"K AS (SELECT F.id, min(A.dst_id) AS app_id, max(F.last_accessed) AS last_accessed FROM F JOIN A ON F.id = A.src_id WHERE F.last_accessed < {NOW - DAY} AND F.id NOT IN (SELECT id FROM Z) GROUP BY 1)",
           select=f"SELECT 'summary:' || app_id || ':{NOW - DAY}' AS id, 'app' AS type, app_id, count(*) AS access_count, app_id AS primary_application, min(last_accessed) AS active_period_start, max(last_accessed) AS active_period_end FROM K GROUP BY app_id"))
def compact_summaries(spark, sf):  # noqa: ANN001, ANN201
    e = activity(spark, sf)
    files = folds.fold_files(e)
    return retention.compact(files, folds.accessed_by(e), _pins(files), NOW - DAY)


@query(sql(E, OPENED, FILES, PINS, select=f"SELECT id, path, last_accessed FROM F WHERE last_accessed >= {NOW - DAY} OR id IN (SELECT id FROM Z)"))
def compact_survivors(spark, sf):  # noqa: ANN001, ANN201
    e = activity(spark, sf)
    files = folds.fold_files(e)
    return retention.survivors(files, folds.accessed_by(e), _pins(files), NOW - DAY).select("id", "path", "last_accessed")


@query(sql(E, select="SELECT strftime(make_timestamp(\"timestamp\"), '%Y-%m-%d') AS day, type, count(*) AS n FROM E GROUP BY 1, 2"))
def day_counts(spark, sf):  # noqa: ANN001, ANN201
    return streams.day_counts(activity(spark, sf)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "type", "n")
