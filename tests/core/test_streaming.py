"""Streams over stored tables: stops between steps, retries, order of rows."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.streaming import streams
from loomgraph.streaming.store import Store, added, latest, set_and_clear
from loomgraph.streaming.trigger import STATE_STORE, crossed, meetings

ROW = "id string, v string, ts long, event string"


def table(spark, path, name=""):
    return sorted(tuple(r) for r in streams.promoted(spark, path, name).select("id", "v").collect())


def test_a_stop_before_the_manifest_loses_no_row(spark, tmp_path):
    path = str(tmp_path / "t")
    streams.upsert(spark.createDataFrame([(f"k{i}", "old", 1, "a") for i in range(50)], ROW), path, ["id"])
    before = table(spark, path)
    store = Store(spark, path)
    snapshot = store.table("")
    # new files are written, the process ends before the manifest is in place
    written, touched = store.folded(store.manifest(), "", spark.createDataFrame([(f"k{i}", "new", 2, "b") for i in range(10)], ROW), ["id"], latest(["id"]))
    assert table(spark, path) == before
    # a half-written manifest is not read
    (tmp_path / "t" / "manifests" / ".half").write_text('{"version": 9')
    assert table(spark, path) == before
    # the batch is tried again
    streams.upsert(spark.createDataFrame([(f"k{i}", "new", 2, "b") for i in range(10)], ROW), path, ["id"])
    assert table(spark, path) == sorted((f"k{i}", "new" if i < 10 else "old") for i in range(50))
    assert snapshot.where("v = 'old'").count() == 50  # a reader stays on its snapshot
    assert len(store.vacuum(keep=1)) == 1  # what the stop left behind
    assert table(spark, path) == sorted((f"k{i}", "new" if i < 10 else "old") for i in range(50))


def test_two_writers_of_one_version(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    base = store.manifest()
    rows = store.write(spark.createDataFrame([("a", "0")], "id string, part string"))
    store.commit(base, {"T": rows}, {})
    with pytest.raises(RuntimeError):
        store.commit(base, {"T": rows}, {})


def test_a_batch_is_committed_once(spark, tmp_path):
    path, fold = str(tmp_path / "t"), {"T": (lambda b: b, ["id"])}
    rows = spark.createDataFrame([("a", "x", 1, "e1")], ROW)
    assert streams.promote_batch(rows, fold, path, "s", 0)["version"] == 1
    assert streams.promote_batch(rows, fold, path, "s", 0)["version"] == 1
    assert streams.promote_batch(rows.limit(0), fold, path, "s", 1)["version"] == 2
    assert table(spark, path, "T") == [("a", "x")]


def test_feed_is_written_once_however_often_a_batch_is_tried(spark, tmp_path):
    path, feed = str(tmp_path / "t"), str(tmp_path / "feed")
    schema = "id string, status string, ts long, event string"
    fold = {"T": (lambda b: b, ["id"])}
    for batch, rows in enumerate([[("a", "active", 1, "1"), ("b", "active", 1, "2")], [("a", "archived", 2, "3"), ("c", "active", 2, "4"), ("b", "active", 2, "5")]]):
        for _ in range(2):  # the second time after a stop behind the commit
            m = streams.promote_batch(spark.createDataFrame(rows, schema), fold, path, "s", batch)
            streams._once(streams._changes(Store(spark, path), m, "T", ["id"]), f"{feed}/batch={batch}")
    got = sorted((r["batch"], r["id"], r["change"]) for r in spark.read.parquet(feed).collect())
    assert got == [(0, "a", "created"), (0, "b", "created"), (1, "a", "archived"), (1, "c", "created")]


def test_sets_and_clears_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    events = [(f"k{rng.randrange(4)}", rng.random() < 0.3, f"d{i}", rng.randrange(40), f"e{i:03d}") for i in range(120)]
    want = {}
    for k, cleared, data, ts, event in sorted(events, key=lambda e: (e[3], e[4])):
        if cleared:
            want.pop(k, None)
        else:
            want[k] = (data, want[k][1] if k in want else ts, ts)
    rng.shuffle(events)
    path, fold = str(tmp_path / "t"), {"A": (lambda b: b, ["id"], set_and_clear(["id"], "data"))}
    for i in range(0, 120, 30):
        streams.promote_batch(spark.createDataFrame(events[i : i + 30], "id string, cleared boolean, data string, ts long, event string"), fold, path, "s", i)
    live = streams.promoted(spark, path, "A", keep=("ts", "event")).where("not cleared").groupBy("id").agg(F.max_by("data", F.struct("ts", "event")).alias("d"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    assert {r["id"]: (r["d"], r["a"], r["b"]) for r in live.collect()} == want


def test_late_first_copies_are_kept(spark, tmp_path):
    hour = 3_600_000_000
    schema = "id string, timestamp long"
    for i, (name, at) in enumerate([("a", 50), ("b", 49), ("c", 51), ("late", 39), ("a", 50)]):
        spark.createDataFrame([(name, at * hour)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streams.ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "log")).collect()) == ["a", "b", "c", "late"]


def test_compaction_rewrites_the_boundary_day(spark, tmp_path):
    path, day = str(tmp_path / "g"), 86_400_000_000
    log = [(f"e{i}", "t", i * day // 4) for i in range(16)]  # four a day
    streams.append_log(spark.createDataFrame(log, "id string, type string, timestamp long"), path, "log", 0)
    streams.append_log(spark.createDataFrame(log[:3] + [("late", "t", 5)], "id string, type string, timestamp long"), path, "log", 1)
    files = spark.createDataFrame([("old", "/old", "a", day), ("pinned", "/p", "a", day), ("new", "/new", "a", 9 * day), ("alone", "/l", "a", day)], "id string, path string, app_id string, last_accessed long").withColumns({"ts": F.col("last_accessed"), "event": F.lit("")})
    ends = ["src_id", "dst_id"]
    edges = spark.createDataFrame([("old", "b"), ("old", "a"), ("pinned", "a"), ("new", "a")], "src_id string, dst_id string").withColumns({"ts": F.lit(0).cast("long"), "event": F.lit("")})
    pins = spark.createDataFrame([("pinned", "File", 0, "")], "node_id string, node_type string, ts long, event string")
    for name, rows, key in (("File", files, ["id"]), ("ACCESSED_BY", edges, ends), ("FILE_PART_OF", edges.limit(0), ends), ("PinnedMarker", pins, ["node_id"])):
        streams.promote_batch(rows, {name: (lambda b: b, key)}, path, name, 0)
    first = streams.compact_graph(spark, path, 5 * day, day + day // 2)
    assert streams.compact_graph(spark, path, 5 * day, day + day // 2) == first
    get = lambda name, *c: sorted(tuple(r) for r in streams.promoted(spark, path, name).select(*c).collect())
    assert get("Log", "id") == sorted((f"e{i}",) for i in range(6, 16))
    assert get("File", "id") == [("alone",), ("new",), ("pinned",)]
    assert get("ACCESSED_BY", *ends) == [("new", "a"), ("pinned", "a")]
    assert get("Summary", "app_id", "access_count") == [("a", 1)] and get("SUMMARIZES", *ends) == [(f"summary:a:{5 * day}", "a")]


def test_a_bad_payload_stops_nothing(spark, tmp_path):
    schema = "id string, v string, ts long, event string"
    sound = lambda b: (b.where("v <> 'bad'"), b.where("v = 'bad'"))
    rows = [(f"k{i % 5}", "bad" if i % 4 == 0 else f"v{i}", i, f"e{i}") for i in range(20)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    path, bad, fold = str(tmp_path / "t"), str(tmp_path / "bad"), {"T": (lambda b: b, ["id"])}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.promote_all(stream, fold, path, str(tmp_path / "cp"), sound=sound, quarantine=bad).awaitTermination()
    assert table(spark, path, "T") == sorted((f"k{k}", f"v{max(i for i in range(20) if i % 5 == k and i % 4)}") for k in range(5))
    left = streams.replay(spark, bad, lambda d: d.withColumn("v", F.when(F.col("ts") != 8, F.concat(F.lit("v"), F.col("ts").cast("string"))).otherwise(F.col("v"))), sound, fold, path)
    assert [r["id"] for r in left.collect()] == ["k3"]
    assert table(spark, path, "T") == [("k0", "v15"), ("k1", "v16"), ("k2", "v17"), ("k3", "v18"), ("k4", "v19")]


@pytest.mark.parametrize("batches", [1, 4])
def test_promotion_at_the_third_file_over_any_batches(spark, tmp_path, batches):
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rng = random.Random(batches)
    opened = [(f"p{rng.randrange(6)}", f"f{rng.randrange(30)}", f"a{rng.randrange(4)}", None) for _ in range(40)]
    focused = [(None, None, f"a{rng.randrange(4)}", f"s{rng.randrange(3)}") for _ in range(6)]
    rows = opened + focused
    rng.shuffle(rows)
    count = {}
    for p, f, a, _ in opened:
        for _, _, b, s in focused:
            if a == b:
                count.setdefault((p, s), set()).add((p, f))
    want = sorted({p for (p, _), files in count.items() if len(files) >= 3})
    schema = "project string, file string, app string, session_id string"
    for i in range(batches):
        own.createDataFrame(rows[i::batches], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        e = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        pairs = meetings(e.where("file is not null").select(F.concat_ws("/", "project", "file").alias("file"), "app"), e.where("file is null").select("app", "session_id"))
        out = crossed(pairs.withColumn("project_id", F.split("file", "/")[0]))
        out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert sorted(r["project_id"] for r in own.read.parquet(str(tmp_path / "out")).collect()) == want and want


def test_days_are_counted_late_and_once(spark, tmp_path):
    """Running counts take an event of any age, and a batch that is tried again only once; closed windows leave out what is later than the watermark."""
    day, src = 86_400_000_000, str(tmp_path / "in")
    schema = "id string, type string, timestamp long"
    batches = [[("a", "x", day), ("b", "y", day + 5)], [("c", "x", 9 * day), ("d", "x", 9 * day + 1)], [("late", "x", day + 1), ("e", "x", 20 * day)], []]
    out, closed, cp = (str(tmp_path / n) for n in ("out", "closed", "cp"))
    for rows in batches:  # one batch a run
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        events = spark.readStream.schema(schema).parquet(src)
        streams.count_days(events, out, cp).awaitTermination()
        windows = streams.day_counts(spark.readStream.schema(schema).parquet(src), "1 day")
        windows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", cp + "-windows").trigger(availableNow=True).start(closed).awaitTermination()
    fold = {"": (streams.day_counts, ["day", "type"], added(["day", "type"]))}
    streams.promote_batch(spark.createDataFrame(batches[1], schema), fold, out, cp, 1)  # the second batch again
    shown = lambda d: sorted(tuple(r) for r in d.select(F.unix_micros("day") / day, "type", "n").collect())
    assert shown(streams.promoted(spark, out)) == [(1, "x", 2), (1, "y", 1), (9, "x", 2), (20, "x", 1)]
    assert shown(spark.read.parquet(closed)) == [(1, "x", 1), (1, "y", 1), (9, "x", 2)]
