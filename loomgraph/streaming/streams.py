"""Ingest, promotion and retention as Structured Streaming queries; batch twins share every expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from loomgraph.operators import retention
from loomgraph.operators.tables import append_absent, changes
from loomgraph.streaming.store import BUCKETS, Store, added, bucket_of, latest

Fold = Callable[[DataFrame], DataFrame]
CAPACITY = 10_000


def shed(batch: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """What a batch over capacity keeps: repeats of (type, source, pid) become their first row with the latest time, empty file reads
    and writes of the kernel source go next, then the newest rows. Under capacity all stays."""
    key = Window.partitionBy("type", "source", "pid").orderBy("timestamp", "id")
    n = batch.count()
    if n <= capacity:
        return batch
    d = batch.withColumns({"k": F.row_number().over(key), "timestamp": F.max("timestamp").over(Window.partitionBy("type", "source", "pid"))}).where("k = 1").drop("k")
    dull = F.col("type").isin("file.read", "file.write") & (F.col("source") == "ebpf") & (F.coalesce(F.length("payload"), F.lit(0)) == 0)
    return d.withColumn("dull", dull).orderBy("dull", "timestamp", "id").limit(capacity).drop("dull")


def _started(events: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _stored(spark: SparkSession, path: str, schema: StructType, by: str) -> DataFrame:
    """The table at path, partitioned by one column; made empty if it isn't there."""
    spark.createDataFrame([], schema).write.mode("append").partitionBy(by).parquet(path)
    return spark.read.schema(schema).parquet(path)


def ingest(events: DataFrame, log_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends each event once, however late it comes: repeats within a batch fall by their id, others by the ids of the log's touched days.

    No watermark stands before the write, so no first copy is lost. A repeat has its event's time, so it meets it in that day. A batch
    that is tried again finds what it wrote before in the log and adds only what is missing.
    """
    spark = events.sparkSession
    _stored(spark, log_path, events.schema.add("day", "date") if "day" not in events.columns else events.schema, "day")

    def write(batch: DataFrame, batch_id: int) -> None:
        b = batch.withColumn("day", F.to_date(F.timestamp_micros("timestamp"))).persist()
        days = [r[0] for r in b.select("day").distinct().collect()]
        old = spark.read.schema(b.schema).parquet(log_path).where(F.col("day").isin(days))
        append_absent(old.select("id"), b).write.mode("append").partitionBy("day").parquet(log_path)
        b.unpersist()

    return _started(events, write, checkpoint, trigger)


def upsert(new: DataFrame, path: str, key: list[str], buckets: int = BUCKETS) -> None:
    """Folds rows (key, columns, ts, event) into the table of the store at path: of each key the latest row stays.

    Only parts of keys that the rows hold are read and written, and the new ones are in place together or not at all. The same rows
    folded in again change nothing.
    """
    store = Store(new.sparkSession, path)
    base = store.manifest()
    written, touched = store.folded(base, "", new, key, latest(key), buckets)
    store.commit(base, {"": written}, {"": touched})


def promote(events: DataFrame, fold: Fold, path: str, checkpoint: str, key: str = "id", trigger: dict | None = None) -> StreamingQuery:
    """Folds each batch by `fold(batch) -> (key, columns, ts, event)` into a node table."""
    return promote_all(events, {"": (fold, [key])}, path, checkpoint, trigger)


def promote_batch(batch: DataFrame, folds: dict[str, tuple], path: str, stream: str, batch_id: int) -> dict:
    """Folds a batch into all tables of the store at path and commits them together, unless the stream's batch is there already; the manifest."""
    store = Store(batch.sparkSession, path)
    base = store.manifest()
    if store.done(base, stream, batch_id):
        return base
    written, touched = {}, {}
    for name, (fold, key, *how) in folds.items():
        written[name], touched[name] = store.folded(base, name, fold(batch), key, how[0] if how else latest(key))
    return store.commit(base, written, touched, stream, batch_id)


def promote_all(events: DataFrame, folds: dict[str, tuple], path: str, checkpoint: str, trigger: dict | None = None, feed: dict[str, str] | None = None, sound: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None, quarantine: str | None = None) -> StreamingQuery:
    """Folds each batch into several node and edge tables of the store at path: {name: (fold, key columns[, how old and new rows fold])}.

    feed: for some tables a folder that gets what each batch created, updated and archived, as batch=N, once however often the batch
    is tried. sound splits a batch into rows that the folds can take and others, which go to the folder quarantine in the same way:
    a bad row stops nothing, and `replay` promotes it later.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        good = batch.persist()
        if sound is not None:
            good, bad = sound(batch)
            _once(bad, f"{quarantine}/batch={batch_id}")
        new = promote_batch(good, folds, path, checkpoint, batch_id)
        for name, folder in (feed or {}).items():
            _once(_changes(Store(batch.sparkSession, path), new, name, folds[name][1]), f"{folder}/batch={batch_id}")
        batch.unpersist()

    return _started(events, write, checkpoint, trigger)


def _once(rows: DataFrame, path: str) -> None:
    """Writes rows to a folder, unless it is written already; half-written it is written anew."""
    jvm, spark = rows.sparkSession._jvm, rows.sparkSession
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        rows.write.mode("overwrite").parquet(path)


def _changes(store: Store, manifest: dict, name: str, key: list[str]) -> DataFrame:
    """What the manifest's commit changed in a table, but for the time and event of the last write: only parts whose folders differ from those before are read."""
    before = store.manifest(manifest["version"] - 1)
    old, new = (m["tables"].get(name, {}).get("parts", {}) for m in (before, manifest))
    parts = [p for p in {*old, *new} if old.get(p) != new.get(p)]
    after, first = (t if t is None else t.drop("ts", "event") for t in (store.table(name, manifest, parts), store.table(name, before, parts)))
    return changes(first if first is not None else after.limit(0), after, *key)


def replay(spark: SparkSession, quarantine: str, mended: Callable[[DataFrame], DataFrame], sound: Callable[[DataFrame], tuple[DataFrame, DataFrame]], folds: dict[str, tuple], path: str) -> DataFrame:
    """Promotes rows of the quarantine that are sound once `mended`, and returns those that still are not. Folds take rows in any order, so the tables end as if the rows had come in time."""
    good, bad = sound(mended(spark.read.parquet(quarantine).drop("batch")))
    store = Store(spark, path)
    promote_batch(good, folds, path, f"replay:{quarantine}", store.manifest()["batches"].get(f"replay:{quarantine}", -1) + 1)
    return bad


def promoted(spark: SparkSession, path: str, name: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """A table that promotion keeps, in its newest snapshot."""
    return Store(spark, path).table(name).drop(*[c for c in ("ts", "event") if c not in keep])


def retain(events: DataFrame, log_path: str, keep_days: int, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """After each batch of events, the log's days older than keep_days before the batch's latest event are emptied: a retention pass that writes back."""
    spark = events.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        latest = batch.agg(F.max(F.to_date(F.timestamp_micros("timestamp")))).first()[0]
        if latest is not None:
            d = spark.read.parquet(log_path).where(F.col("day") < F.date_sub(F.lit(latest), keep_days))
            log = spark.read.parquet(log_path)
            for (day,) in d.select("day").distinct().collect():  # a row for each expired day
                spark.createDataFrame([], log.drop("day").schema).write.mode("overwrite").parquet(f"{log_path}/day={day}")

    return _started(events, write, checkpoint, trigger)


def append_log(events: DataFrame, path: str, stream: str, batch_id: int) -> dict:
    """Appends a batch to the table Log of the store at path, in parts by day: each event once, as in `ingest`."""
    store = Store(events.sparkSession, path)
    base = store.manifest()
    if store.done(base, stream, batch_id):
        return base
    b = events.withColumn("part", F.date_format(F.timestamp_micros("timestamp"), "yyyy-MM-dd"))
    old = store.table("Log", base, [r[0] for r in b.select("part").distinct().collect()])  # a row for each day
    return store.commit(base, {"Log": store.write(append_absent(None if old is None else old.select("id"), b))}, {}, stream, batch_id)


def compact_graph(spark: SparkSession, path: str, files_before: int, log_before: int, edges: tuple[str, ...] = ("ACCESSED_BY", "FILE_PART_OF"), mode: str = "first_app") -> dict:
    """One retention pass over the store at path, all in one commit: the log loses events before log_before, its boundary day is rewritten; unpinned
    files last accessed before files_before become Summary rows with SUMMARIZES edges, and go with all their edges. Without anything to do nothing is committed."""
    store = Store(spark, path)
    base = store.manifest()
    written, replaced = {}, {}
    if "Log" in base["tables"]:
        days = sorted(base["tables"]["Log"]["parts"])
        edge = spark.sql(f"SELECT date_format(timestamp_micros({log_before}), 'yyyy-MM-dd')").first()[0]
        whole = [d for d in days if d < edge]
        cut = store.table("Log", base, [edge]) if edge in days else None
        cut = cut if cut is not None and not cut.where(F.col("timestamp") < log_before).isEmpty() else None
        if whole or cut is not None:
            kept = retention.purge(cut, log_before) if cut is not None else store.table("Log", base, []).limit(0)
            written["Log"], replaced["Log"] = store.write(kept.withColumn("part", F.lit(edge))), [*whole, *([edge] if cut is not None else [])]
    files, accessed = store.table("File", base), store.table("ACCESSED_BY", base)
    if files is not None and accessed is not None:
        pins = store.table("PinnedMarker", base)
        pins = pins if pins is not None else spark.createDataFrame([], "node_id string, node_type string")
        gone = retention.old_files(files, pins, files_before).join(accessed.select(F.col("src_id").alias("id")), "id", "left_semi").select("id").persist()
        if not gone.isEmpty():
            summaries = retention.compact(files, accessed, pins, files_before, mode).persist()
            at = {"ts": F.lit(files_before).cast("long"), "event": F.lit("")}
            written["Summary"], replaced["Summary"] = store.folded(base, "Summary", summaries.withColumns(at), ["id"], latest(["id"]))
            over = summaries.select(F.col("id").alias("src_id"), F.col("app_id").alias("dst_id")).withColumns(at)
            written["SUMMARIZES"], replaced["SUMMARIZES"] = store.folded(base, "SUMMARIZES", over, ["src_id", "dst_id"], latest(["src_id", "dst_id"]))
            for name, key, ends in (("File", ["id"], ("id",)), *((e, ["src_id", "dst_id"], ("src_id", "dst_id")) for e in edges)):
                if name not in base["tables"]:
                    continue
                rows = store.table(name, base).withColumn("part", bucket_of(key))
                hit = None
                for end in ends:
                    h = rows.join(gone.withColumnRenamed("id", end), end, "left_semi").select("part")
                    hit = h if hit is None else hit.unionByName(h)
                parts = [r[0] for r in hit.distinct().collect()]  # at most the buckets
                rest = store.table(name, base, parts)
                rest = rest.join(gone, "id", "left_anti") if name == "File" else retention.drop_edges(rest, gone)
                written[name], replaced[name] = store.write(rest.withColumn("part", bucket_of(key))), parts
            summaries.unpersist()
        gone.unpersist()
    return store.commit(base, written, replaced) if written else base


def day_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events by UTC day and type, in batch or over a stream with a watermark."""
    d = events.withColumn("ts", F.timestamp_micros("timestamp"))
    d = d.withWatermark("ts", late) if events.isStreaming else d
    return d.groupBy(F.window("ts", "1 day").alias("w"), "type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "type", "n")


def count_days(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keeps the counts of `day_counts` in the store at path: each batch's are added to those of its days, once however often it is tried.

    No window is ever closed, so events count however late they come. Where closed windows are wanted, write `day_counts` of the
    stream itself in append mode: it then gives each window once, without events later than its watermark.
    """
    return promote_all(events, {"": (day_counts, ["day", "type"], added(["day", "type"]))}, path, checkpoint, trigger)


def drop_late(events: DataFrame, high_water: int) -> DataFrame:
    """The option to leave out events at or before the last one promoted."""
    return events.where(F.col("timestamp") > high_water)
