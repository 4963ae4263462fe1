"""Driver queries that run the streams over the given events, dealt into files, and return what the tables then hold."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.scalars import uuid5
from loomgraph.operators import folds, paths
from loomgraph.plans import graph
from loomgraph.plans.base import ACCESSED, ACTIVE, DAY, FILES, FOCUSED, NEAREST, NOW, OPENED, PART_OF, ROOTS, E, activity, roots, sql
from loomgraph.plans.checkpoints import ensure
from loomgraph.sources import wire
from loomgraph.sources.events import decode, stream_events
from loomgraph.streaming import streams
from loomgraph.streaming.store import set_and_clear
from loomgraph.streaming.trigger import STATE_STORE, crossed, meetings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _envelopes(spark: SparkSession, sf: str) -> DataFrame:
    payload = F.to_json(F.struct("path", "app_id", F.lit(0).cast("bigint").alias("flags")))
    return activity(spark, sf).select("id", "type", "timestamp", "source", F.col("pid").cast("bigint").alias("pid"), "session_id", F.when(F.col("type") == "file.opened", payload).alias("payload"), F.col("uid").cast("bigint").alias("uid"), F.lit(None).cast("string").alias("project_id"))


@query(sql(E, select='SELECT id, type, "timestamp" FROM E'))
def stream_ingest(spark, sf):  # noqa: ANN001, ANN201
    """Events with a tenth of them sent twice, read as a stream of files that each span the whole time: the log has each once, the late ones too."""
    e = _envelopes(spark, sf)
    src, log = _folder(spark, "in"), _folder(spark, "log")
    e.unionByName(e.where("cast(id as bigint) % 10 = 0")).repartition(5).write.parquet(src)
    streams.ingest(stream_events(spark, src, files_per_trigger=2), log, _folder(spark, "cp")).awaitTermination()
    return spark.read.parquet(log).select("id", "type", "timestamp")


@query(sql(E, OPENED, FILES, select="SELECT * FROM F"))
def stream_promote(spark, sf):  # noqa: ANN001, ANN201
    """File nodes folded batch by batch equal those folded at once."""
    src, out = _folder(spark, "in"), _folder(spark, "files")
    _envelopes(spark, sf).where("type = 'file.opened'").repartition(4, "id").write.parquet(src)

    def fold(batch: DataFrame) -> DataFrame:
        d = folds.opened(decode(batch, "file.opened")[0]).select(F.col("file").alias("id"), "path", F.col("app").alias("app_id"), F.col("ts").alias("last_accessed"), "ts", F.col("id").alias("event"))
        return d.groupBy("id").agg(F.max_by(F.struct("path", "app_id", "last_accessed", "ts", "event"), F.struct("ts", "event")).alias("r")).select("id", "r.*")

    streams.promote(stream_events(spark, src, files_per_trigger=2), fold, out, _folder(spark, "cp")).awaitTermination()
    return streams.promoted(spark, out).select("id", "path", "app_id", "last_accessed")


LAST_NAME = "(SELECT app AS id, app_name AS name, ts, id AS event FROM O UNION ALL SELECT app, app, ts, id FROM W)"
GRAPH = f"""GR AS (SELECT 'App' AS label, id, arg_max(name, (ts, event)) AS a, NULL AS b FROM {LAST_NAME} GROUP BY id
 UNION ALL SELECT 'Session', session_id, CAST(max(ts) AS VARCHAR), NULL FROM W WHERE session_id IS NOT NULL GROUP BY session_id
 UNION ALL SELECT DISTINCT 'ACCESSED_BY', file, app, NULL FROM O UNION ALL SELECT DISTINCT 'ACTIVE_IN', app, session_id, NULL FROM W WHERE session_id IS NOT NULL
 UNION ALL SELECT 'Event', id, window_title, CAST("timestamp" AS VARCHAR) FROM E WHERE type = 'window.focused'
 UNION ALL SELECT 'EMITTED_BY', id, app, NULL FROM W UNION ALL SELECT 'DERIVED_FROM', id, id, NULL FROM E WHERE type IN ('app.presence.set', 'app.presence.clear', 'app.timeline.record')
 UNION ALL SELECT 'UserAction', id, CASE type WHEN 'app.presence.set' THEN activity WHEN 'app.presence.clear' THEN 'clear' ELSE record_type END,
  CASE type WHEN 'app.presence.set' THEN 'presence|' || subject WHEN 'app.presence.clear' THEN 'presence|' || app_id ELSE 'timeline|' || label END || '|' ||
  CASE WHEN type = 'app.timeline.record' THEN coalesce(nullif(ended_at, 0), nullif(started_at, 0), "timestamp") ELSE "timestamp" END FROM E WHERE type IN ('app.presence.set', 'app.presence.clear', 'app.timeline.record'))"""


def graph_folds() -> dict[str, tuple]:
    """The folds of all nodes and edges that events bring about."""
    at = (F.col("ts"), F.col("event"))
    opened = lambda b: folds.opened(b).withColumnRenamed("id", "event")
    focused = lambda b: folds.focused(b).withColumnRenamed("id", "event")
    actions = lambda b: folds.user_actions(b).select("*", F.col("timestamp").alias("ts"), F.col("id").alias("event"))
    edge = lambda d, a, b: d.select(F.col(a).alias("src_id"), F.col(b).alias("dst_id"), *at).where("src_id is not null and dst_id is not null")
    ends = ["src_id", "dst_id"]
    return {
        "File": (lambda b: opened(b).select(F.col("file").alias("id"), "path", F.col("app").alias("app_id"), F.col("ts").alias("last_accessed"), *at), ["id"]),
        "App": (lambda b: opened(b).select(F.col("app").alias("id"), F.col("app_name").alias("name"), *at).unionByName(focused(b).select(F.col("app").alias("id"), F.col("app").alias("name"), *at)), ["id"]),
        "Session": (lambda b: focused(b).where("session_id is not null").select(F.col("session_id").alias("id"), F.col("ts").alias("started_at"), *at), ["id"]),
        "Event": (lambda b: focused(b).select(F.col("event").alias("id"), "title", F.col("ts").alias("timestamp"), *at), ["id"]),
        "UserAction": (actions, ["id"]),
        "ACCESSED_BY": (lambda b: edge(opened(b), "file", "app"), ends),
        "ACTIVE_IN": (lambda b: edge(focused(b), "app", "session_id"), ends),
        "EMITTED_BY": (lambda b: edge(focused(b).withColumn("id", F.col("event")), "id", "app"), ends),
        "DERIVED_FROM": (lambda b: edge(actions(b), "id", "event"), ends),
    }


@query(sql(E, OPENED, FOCUSED, GRAPH, select="SELECT * FROM GR"))
def stream_graph(spark, sf):  # noqa: ANN001, ANN201
    """Apps, sessions, window events, actions and edges promoted from one stream, batch by batch, with their names and times."""
    src, out = _folder(spark, "in"), _folder(spark, "graph")
    activity(spark, sf).repartition(4, "id").write.parquet(src)
    streams.promote_all(_files(spark, sf, src, 2), graph_folds(), out, _folder(spark, "cp")).awaitTermination()
    none = F.lit(None).cast("string")
    columns = {
        "App": ("id", "name", none), "Session": ("id", F.col("started_at").cast("string"), none), "Event": ("id", "title", F.col("timestamp").cast("string")),
        "UserAction": ("id", "action", F.concat_ws("|", "category", "subject", "timestamp")), **dict.fromkeys(("ACCESSED_BY", "ACTIVE_IN", "EMITTED_BY", "DERIVED_FROM"), ("src_id", "dst_id", none)),
    }
    parts = [streams.promoted(spark, out, name).select(F.lit(name).alias("label"), F.col(i).alias("id"), (F.col(a) if isinstance(a, str) else a).alias("a"), b.alias("b")) for name, (i, a, b) in columns.items()]
    return reduce(DataFrame.unionByName, parts)


def _files(spark, sf, src, at_once=1):  # noqa: ANN001, ANN202
    """The activity written to src as a stream of files."""
    return spark.readStream.schema(activity(spark, sf).schema).option("maxFilesPerTrigger", at_once).parquet(src)


def _in_runs(spark, sf, runs, start):  # noqa: ANN001, ANN202
    """Writes rows of the activity in turn to a folder, ending the stream that start(events) begins and beginning it anew for each: one batch a run."""
    src = _folder(spark, "in")
    for rows in runs:
        rows.coalesce(1).write.mode("append").parquet(src)
        start(_files(spark, sf, src)).awaitTermination()


KEY = ["target_type", "target_id", "namespace"]


@query(graph.SQL["annotation_state"])
def stream_annotations(spark, sf):  # noqa: ANN001, ANN201
    """Annotations set and cleared in a stream whose batches mix old and new events: clears leave marks, so late sets before them stay dead."""
    out, cp = _folder(spark, "annotations"), _folder(spark, "cp")

    def fold(batch: DataFrame) -> DataFrame:
        d = graph.annotated(batch)
        return d.select(*KEY, (F.col("type") == "app.annotation.cleared").alias("cleared"), F.col("data_json").alias("data"), F.col("timestamp").alias("ts"), F.col("id").alias("event"))

    e = activity(spark, sf)
    runs = [e.where(f"pmod(hash(id), 3) = {i}") for i in range(3)]
    _in_runs(spark, sf, runs, lambda s: streams.promote_all(s, {"Annotation": (fold, KEY, set_and_clear(KEY, "data"))}, out, cp))
    live = streams.promoted(spark, out, "Annotation", keep=("ts", "event")).where("not cleared")
    return live.groupBy(*KEY).agg(F.max_by("data", F.struct("ts", "event")).alias("data"), F.min("ts").alias("created_at"), F.max("ts").alias("last_modified")).select(uuid5(folds.ANNOTATIONS, *[F.col(k) for k in KEY]).alias("id"), *KEY, "data", "created_at", "last_modified")


DEEP = (E.replace("E AS (", "E0 AS (", 1), "E AS (SELECT * REPLACE (CASE WHEN path <> '' THEN path || '/f' || id ELSE path END AS path) FROM E0)")


def _deep(spark, sf):  # noqa: ANN001, ANN202
    """The activity with a file of its own for each opening, so that projects have many files and these grow with the log."""
    return activity(spark, sf).withColumn("path", F.when(F.col("path") != "", F.concat("path", F.lit("/f"), "id")).otherwise(F.col("path")))


@query(sql(*DEEP, OPENED, FOCUSED, FILES, ACCESSED, ACTIVE, ROOTS, NEAREST, PART_OF, graph.COUNTS, select="SELECT DISTINCT project_id AS id FROM C JOIN R USING (project_id) WHERE R.inferred AND files >= 3"))
def stream_promotion(spark, sf):  # noqa: ANN001, ANN201
    """Inferred projects promoted by a stream once each, when an app of a session has touched their third file: state by app and by project lasts over restarts."""
    own = spark.newSession()  # the state store is set for these streams only
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    own.conf.set("spark.sql.session.timeZone", "UTC")
    out, cp = _folder(spark, "promoted"), _folder(spark, "cp")
    e = _deep(spark, sf)
    inferred = roots(own, sf).where("inferred").select(F.col("project_id").alias("project"))
    near = paths.nearest_ancestor(folds.fold_files(_deep(own, sf)).where("path <> ''"), roots(own, sf)).join(inferred, F.col("project_id") == F.col("project")).select(F.col("path").alias("file"), "project_id")

    def start(s: DataFrame):  # noqa: ANN202
        pairs = meetings(folds.opened(s), folds.focused(s)).join(near, "file")
        return crossed(pairs).writeStream.format("parquet").option("checkpointLocation", cp).trigger(availableNow=True).start(out)

    _in_runs(own, sf, [e.where(f"pmod(hash(id), 2) = {i}") for i in range(2)], start)
    return spark.read.parquet(out).select(F.col("project_id").alias("id"))


PROJECTS = "Y AS (SELECT 'p' || k || '-' || (pid % 50) AS id, 'n' || (value > 50) AS name, CASE WHEN k % 7 = 0 THEN 'archived' ELSE 'active' END AS status, \"timestamp\" AS ts, id AS event, CAST(id AS BIGINT) % 3 AS batch FROM E WHERE type <> 'app.timeline.record')"


def _feed_sql() -> str:
    states = [f"S{i} AS (SELECT id, arg_max(name, (ts, event)) AS name, arg_max(status, (ts, event)) AS status FROM Y WHERE batch <= {i} GROUP BY id)" for i in range(3)]
    states.append("Sx AS (SELECT * FROM S0 WHERE FALSE)")
    kind = "CASE WHEN b.id IS NULL THEN 'created' WHEN a.status = 'archived' AND b.status <> 'archived' THEN 'archived' ELSE 'updated' END"
    steps = [f"SELECT {i} AS batch, a.id, {kind} AS change, a.name, a.status FROM S{i} a LEFT JOIN S{'x' if i == 0 else i - 1} b ON a.id = b.id WHERE b.id IS NULL OR a.name <> b.name OR a.status <> b.status" for i in range(3)]
    return sql(E, PROJECTS, *states, select=" UNION ALL ".join(steps))


@query(_feed_sql())
def stream_changes(spark, sf):  # noqa: ANN001, ANN201
    """The change feed of a table that a stream keeps: what each batch created, updated and archived, equal to the differences of the snapshots."""
    out, cp, feed = _folder(spark, "projects"), _folder(spark, "cp"), _folder(spark, "feed")

    def fold(b: DataFrame) -> DataFrame:
        name, status = F.concat(F.lit("n"), (F.col("value") > 50).cast("string")), F.when(F.col("k") % 7 == 0, "archived").otherwise("active")
        pid = F.concat(F.lit("p"), F.col("k").cast("string"), F.lit("-"), (F.col("pid") % 50).cast("string"))
        return b.where("type <> 'app.timeline.record'").select(pid.alias("id"), name.alias("name"), status.alias("status"), F.col("timestamp").alias("ts"), F.col("id").alias("event"))

    e = activity(spark, sf)
    _in_runs(spark, sf, [e.where(f"cast(id as bigint) % 3 = {i}") for i in range(3)], lambda s: streams.promote_all(s, {"Project": (fold, ["id"])}, out, cp, feed={"Project": feed}))
    d = spark.read.parquet(feed)
    return d.select(F.col("batch").cast("int").alias("batch"), "id", "change", "name", "status")


@query(sql(E, OPENED, FILES, select="SELECT * FROM F"))
def stream_quarantine(spark, sf):  # noqa: ANN001, ANN201
    """File nodes of a stream in which every tenth payload is broken: the others are promoted, the broken ones wait and are promoted once they are mended."""
    src, out, bad = _folder(spark, "in"), _folder(spark, "files"), _folder(spark, "quarantine")
    e = _envelopes(spark, sf).where("type = 'file.opened'")
    broken = F.get_json_object("payload", "$.path").isin("", *[f"/k/{k}" for k in range(0, 100, 10)])
    e.withColumn("payload", F.when(broken, F.substring("payload", F.lit(1), F.length("payload") - 1)).otherwise(F.col("payload"))).repartition(4, "id").write.parquet(src)
    table = {"File": (lambda b: folds.opened(b).select(F.col("file").alias("id"), "path", F.col("app").alias("app_id"), F.col("ts").alias("last_accessed"), "ts", F.col("id").alias("event")), ["id"])}
    sound = lambda rows: decode(rows.select(*stream_events(spark, src).columns), "file.opened")
    streams.promote_all(stream_events(spark, src, files_per_trigger=2), table, out, _folder(spark, "cp"), sound=sound, quarantine=bad).awaitTermination()
    mended = lambda rows: rows.withColumn("payload", F.concat("payload", F.lit("}")))
    streams.replay(spark, bad, mended, sound, table, out)
    return streams.promoted(spark, out, "File").select("id", "path", "app_id", "last_accessed")


CUT, LOG_CUT = NOW - 3 * DAY, NOW - 10 * DAY - DAY // 3
COMPACTED = (
    f"G AS (SELECT F.id, min(A.dst_id) AS app_id, max(F.last_accessed) AS last_accessed FROM F JOIN A ON F.id = A.src_id WHERE F.last_accessed < {CUT} GROUP BY 1)",
    f"U AS (SELECT 'summary:' || app_id || ':{CUT}' AS id, app_id, count(*) AS n, min(last_accessed) AS lo, max(last_accessed) AS hi FROM G GROUP BY app_id)",
    f"""X AS (SELECT 'Summary' AS label, id, app_id AS a, n || '|' || lo || '|' || hi AS b FROM U UNION ALL SELECT 'SUMMARIZES', id, app_id, NULL FROM U
 UNION ALL SELECT 'File', id, app_id, CAST(last_accessed AS VARCHAR) FROM F WHERE id NOT IN (SELECT id FROM G) UNION ALL SELECT 'ACCESSED_BY', src_id, dst_id, NULL FROM A WHERE src_id NOT IN (SELECT id FROM G)
 UNION ALL SELECT 'Log', id, type, CAST("timestamp" AS VARCHAR) FROM E WHERE "timestamp" >= {LOG_CUT})""",
)


@query(sql(*DEEP, OPENED, FILES, ACCESSED, *COMPACTED, select="SELECT * FROM X"))
def stream_compaction(spark, sf):  # noqa: ANN001, ANN201
    """Log, files and edges that a stream brought in, after a retention pass that changed all of them in one commit, and a second one that found nothing to do."""
    out, cp, only = _folder(spark, "graph"), _folder(spark, "cp"), ("File", "ACCESSED_BY")
    e = _deep(spark, sf)
    tables = {name: fold for name, fold in graph_folds().items() if name in only}

    def start(s: DataFrame):  # noqa: ANN202
        def write(batch: DataFrame, batch_id: int) -> None:
            streams.append_log(batch.select("id", "type", "timestamp"), out, "log", batch_id)
            streams.promote_batch(batch, tables, out, cp, batch_id)

        return s.writeStream.foreachBatch(write).option("checkpointLocation", cp).trigger(availableNow=True).start()

    _in_runs(spark, sf, [e.where(f"pmod(hash(id), 2) = {i}") for i in range(2)], start)
    first = streams.compact_graph(spark, out, CUT, LOG_CUT)
    if streams.compact_graph(spark, out, CUT, LOG_CUT)["version"] != first["version"]:
        raise RuntimeError("a second pass changed the store")
    none = F.lit(None).cast("string")
    columns = {"Summary": ("id", "app_id", F.concat_ws("|", "access_count", "active_period_start", "active_period_end")), "SUMMARIZES": ("src_id", "dst_id", none), "File": ("id", "app_id", F.col("last_accessed").cast("string")), "ACCESSED_BY": ("src_id", "dst_id", none), "Log": ("id", "type", F.col("timestamp").cast("string"))}
    return reduce(DataFrame.unionByName, [streams.promoted(spark, out, name, keep=()).select(F.lit(name).alias("label"), F.col(i).alias("id"), F.col(a).alias("a"), b.alias("b")) for name, (i, a, b) in columns.items()])


@query(sql(E, """DY AS (SELECT *, CAST(make_timestamp("timestamp") AS DATE) AS day FROM E)""", select="SELECT id FROM DY WHERE day >= (SELECT max(day) FROM DY) - INTERVAL 7 DAY"))
def stream_retention(spark, sf):  # noqa: ANN001, ANN201
    """The log after a retention pass over what a stream brought in."""
    e = _envelopes(spark, sf)
    src, log = _folder(spark, "in"), _folder(spark, "log")
    e.repartitionByRange(3, "timestamp").write.parquet(src)
    streams.ingest(stream_events(spark, src), log, _folder(spark, "cp")).awaitTermination()
    streams.retain(stream_events(spark, src), log, 7, _folder(spark, "cp")).awaitTermination()
    return spark.read.parquet(log).select("id")


@query(graph.SQL["day_counts"])
def stream_day_counts(spark, sf):  # noqa: ANN001, ANN201
    """Events by day and type, counted batch by batch over files that each span the whole time."""
    src, out = _folder(spark, "in"), _folder(spark, "days")
    activity(spark, sf).repartition(4).write.parquet(src)
    streams.count_days(_files(spark, sf, src, 2), out, _folder(spark, "cp")).awaitTermination()
    return streams.promoted(spark, out).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "type", "n")


@query(sql(E, "B AS (SELECT id, CASE WHEN type = 'file.opened' THEN 'file.read' ELSE type END AS type, CASE WHEN type = 'file.opened' THEN 'ebpf' ELSE source END AS source, pid, \"timestamp\" FROM E)",
           "G AS (SELECT arg_min(id, (\"timestamp\", id)) AS id, type, source, max(\"timestamp\") AS ts FROM B GROUP BY type, source, pid)",
           select="SELECT id, type, ts AS \"timestamp\" FROM G ORDER BY type = 'file.read', ts, id LIMIT 500"))
def shed_batch(spark, sf):  # noqa: ANN001, ANN201
    e = activity(spark, sf)
    opened = F.col("type") == "file.opened"
    b = e.select("id", F.when(opened, "file.read").otherwise(F.col("type")).alias("type"), F.when(opened, "ebpf").otherwise(F.col("source")).alias("source"), "pid", "timestamp", F.lit("").alias("payload"))
    return streams.shed(b, 500).select("id", "type", "timestamp")


@query(sql(E, select="SELECT id, path, app_id FROM E WHERE type = 'file.opened'"))
def payload_decode(spark, sf):  # noqa: ANN001, ANN201
    return decode(_envelopes(spark, sf), "file.opened")[0].select("id", "path", "app_id")


def _binary(e):  # noqa: ANN001, ANN202
    """Openings of files as binary messages with a field that nobody knows; every tenth ends too early."""
    text = lambda tag, c: F.concat(F.unhex(F.lit(tag)), F.unhex(F.lpad(F.hex(F.octet_length(c)), 2, "0")), F.encode(c, "UTF-8"))
    message = F.concat(F.unhex(F.lit("7A017A")), text("0A", F.col("path")), text("12", F.col("app_id")), F.unhex(F.lit("18")), F.unhex(F.lpad(F.hex(F.col("k") % 100), 2, "0")))
    whole = e.where("type = 'file.opened'").withColumn("message", message)
    return whole.select("id", "type", F.expr("CASE WHEN k % 10 = 0 THEN substring(message, 1, length(message) - 1) ELSE message END").alias("payload"))


@query(sql(E, select="SELECT id, path, app_id, k % 100 AS flags FROM E WHERE type = 'file.opened' AND k % 10 <> 0"))
def payload_binary(spark, sf):  # noqa: ANN001, ANN201
    return wire.decode(_binary(activity(spark, sf)), "file.opened")[0].select("id", "path", "app_id", "flags")


@query(sql(E, select="SELECT id FROM E WHERE type = 'file.opened' AND k % 10 = 0"))
def payload_binary_quarantine(spark, sf):  # noqa: ANN001, ANN201
    return wire.decode(_binary(activity(spark, sf)), "file.opened")[1].select("id")


@query(sql(E, select="SELECT id FROM E WHERE type = 'file.opened' AND k % 10 = 0"))
def payload_quarantine(spark, sf):  # noqa: ANN001, ANN201
    e = activity(spark, sf)
    broken = F.when(F.col("k") % 10 == 0, "{oops").otherwise(F.to_json(F.struct("path", "app_id")))
    return decode(e.select("id", "type", broken.alias("payload")), "file.opened")[1].select("id")
