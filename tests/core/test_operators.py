"""Operators on hand-made frames."""

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import scalars as X
from loomgraph.operators import access, counters, dedup, folds, lifecycle, migrate, paths, projects, quota, ranks, retention, tables, timeline, validation
from loomgraph.sources import export
from loomgraph.sources.events import decode
from loomgraph.streaming import streams


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def event(i, kind, ts, **more):
    base = {"id": f"id-{i}", "type": kind, "timestamp": ts, "source": "src", "pid": 1, "session_id": "s1", "uid": 0}
    payload = dict.fromkeys(("path", "app_id", "window_title", "activity", "subject", "label", "record_type", "target_type", "target_id", "namespace", "data_json"))
    return base | payload | {"started_at": 0, "ended_at": 0} | more


def log(spark, events):
    schema = "id string, type string, timestamp long, source string, pid long, session_id string, uid long, path string, app_id string, window_title string, activity string, subject string, label string, record_type string, target_type string, target_id string, namespace string, data_json string, started_at long, ended_at long"
    return spark.createDataFrame([tuple(e[c.split()[0]] for c in schema.split(", ")) for e in events], schema)


def test_append_absent(spark):
    b = spark.createDataFrame([("id-1", 1), ("id-1", 2), ("id-2", 3)], "id string, timestamp long")
    assert rows(tables.append_absent(None, b), "id", "timestamp") == [("id-1", 1), ("id-2", 3)]
    assert rows(tables.append_absent(b.where("id = 'id-1'"), b), "id") == [("id-2",)]


def test_timeline_time_falls_back(spark):
    e = [event(1, "app.timeline.record", 10_000_000, started_at=5_000_000, ended_at=9_500_000), event(2, "app.timeline.record", 7_777_777), event(3, "app.timeline.record", 9, started_at=4)]
    assert rows(folds.user_actions(log(spark, e)), "id", "timestamp") == [("id-1", 9_500_000), ("id-2", 7_777_777), ("id-3", 4)]


def test_presence(spark):
    e = [event(1, "app.presence.set", 1, app_id="a", activity="editing"), event(2, "app.presence.clear", 5, app_id="a"), event(3, "app.presence.set", 9, app_id="a", activity="x")]
    assert rows(folds.presence_intervals(log(spark, e)), "activity", "start", "end") == [("editing", 1, 5), ("x", 9, None)]
    assert rows(folds.user_actions(log(spark, e)), "action") == [("clear",), ("editing",), ("x",)]


@pytest.mark.parametrize("seed", range(3))
def test_annotations_in_any_order(spark, seed):
    k = {"target_type": "File", "target_id": "f"}
    e = [
        event(1, "app.annotation.set", 1000, namespace="n", data_json="a", **k), event(2, "app.annotation.set", 5000, namespace="n", data_json="b", **k),
        event(3, "app.annotation.set", 10, namespace="m", data_json="c", **k), event(4, "app.annotation.cleared", 20, namespace="m", **k),
        event(5, "app.annotation.cleared", 30, namespace="absent", **k), event(6, "app.annotation.set", 40, namespace="m2", data_json="d", **k),
    ]
    random.Random(seed).shuffle(e)
    d = folds.annotation_state(log(spark, e))
    assert rows(d, "namespace", "data", "created_at", "last_modified") == [("m2", "d", 40, 40), ("n", "b", 1000, 5000)]
    assert rows(d.where("namespace = 'n'"), "id") == [(str(uuid.uuid5(folds.ANNOTATIONS, "File\x1ff\x1fn")),)]


def test_folds(spark):
    e = [event(1, "file.opened", 5, path="/a", app_id="x"), event(2, "file.opened", 9, path="/a", app_id="y"), event(3, "file.opened", 7, path="", app_id=""), event(4, "window.focused", 3, app_id="x"), event(5, "window.focused", 8, app_id="x")]
    d = log(spark, e)
    assert rows(folds.fold_files(d), "id", "app_id", "last_accessed") == [("/a", "y", 9), ("unknown:id-3", "src:1", 7)]
    assert rows(folds.fold_apps(d), "id", "name") == [("src:1", "src"), ("x", "x"), ("y", "src")]
    assert rows(folds.fold_sessions(d), "started_at") == [(8,)]
    assert rows(folds.fold_sessions(d, "first"), "started_at") == [(3,)]


@pytest.mark.parametrize("boundary", ["", "/"])
def test_nearest_ancestor(spark, boundary):
    rng = random.Random(11)
    place = lambda depth: "".join("/" + rng.choice(["u", "uv", "w"]) for _ in range(depth))
    tops = {place(rng.randrange(1, 4)): f"p{i}" for i in range(12)}
    asked = [place(rng.randrange(1, 6)) for _ in range(150)] + ["", None, "relative", *tops]
    begins = lambda p, r: p.startswith(r) and (not boundary or p == r or p[len(r)] == "/")
    want = {(p, tops[max(hits, key=len)]) for p in asked if p is not None and (hits := [r for r in tops if begins(p, r)])}
    r = spark.createDataFrame([(i, p) for p, i in tops.items()], "project_id string, root_path string")
    d = spark.createDataFrame([(p,) for p in asked], "path string")
    assert rows(paths.nearest_ancestor(d, r, boundary), "path", "project_id") == sorted(want, key=repr)
    assert rows(paths.nearest_ancestor(d, r.limit(0), boundary), "path") == []


def test_nearest_as_of(spark):
    rng = random.Random(12)
    spans = [(f"p{i:02d}", "/" + "ab"[: rng.randrange(1, 3)] + "/c" * rng.randrange(2), a := rng.choice([None, rng.randrange(1000), rng.randrange(10**15)]), rng.choice([None, (a or 0) + 10 ** rng.randrange(15), a])) for i in range(40)]
    spans += [("px", "", None, None), ("py", "/a", 50, 40)]
    points = [("/" + rng.choice(["a", "ab", "b"]) + "/c" * rng.randrange(3), rng.choice([rng.randrange(1200), rng.randrange(10**15), *[x for s in spans for x in s[2:] if x is not None]])) for _ in range(200)] + [(None, 1), ("/a", None), ("/a", -5), ("/a", 10**18)]
    best = {}
    for p, t in points:
        for name, r, a, b in spans:
            if p is not None and t is not None and r and p.startswith(r) and (a is None or a <= t) and (b is None or t <= b) and (a is None or b is None or a <= b):
                best[p, t] = max(best.get((p, t), (0, "")), (len(r), name))
    d = paths.nearest_as_of(spark.createDataFrame(points, "path string, at long"), spark.createDataFrame(spans, "project_id string, root_path string, created_at long, archived_at long"))
    assert rows(d, "path", "at", "project_id") == sorted(((p, t, name) for (p, t), (_, name) in best.items()), key=repr)
    assert paths.nearest_as_of(spark.createDataFrame(points, "path string, at long"), spark.createDataFrame([], "project_id string, root_path string, created_at long, archived_at long")).count() == 0


@pytest.mark.parametrize(("by", "order"), [(["k"], ["v", "i"]), ([], ["v", "i"])])
def test_numbers_of_ordered_rows(spark, by, order):
    rng = random.Random(13)
    data = [("hot" if rng.random() < 0.4 else rng.choice(["a", "b", None]), rng.randrange(9), i) for i in range(500)]
    got = ranks.numbered(spark.createDataFrame(data, "k string, v int, i int"), by, order, "n", parts=7).collect()
    groups = {}
    for r in sorted(data, key=lambda r: r[1:]):
        groups.setdefault(r[0] if by else "", []).append(r)
    assert sorted((r["i"], r["n"]) for r in got) == sorted((r[2], n) for g in groups.values() for n, r in enumerate(g, 1))
    assert ranks.numbered(spark.createDataFrame([], "k string, v int, i int"), by, order).count() == 0


def test_names_are_numbered_without_a_task_that_holds_one(spark):
    d = spark.createDataFrame([(f"/{i:03d}/x.txt",) for i in range(300)] + [("/q/y",), ("",)], "path string")
    out = timeline.with_display_names(d, [])
    assert rows(out, "path", "display")[:2] == [("/000/x.txt", "x.txt"), ("/001/x.txt", "x_2.txt")] and out.count() == 301
    assert "Window [row_number" not in out._jdf.queryExecution().executedPlan().toString()


def test_promotion_threshold(spark):
    edge = "src_id string, dst_id string"
    for n, crossed in ((2, False), (3, True)):
        part = spark.createDataFrame([(f"f{i}", "p") for i in range(n)], edge)
        c = folds.session_file_counts(part, spark.createDataFrame([(f"f{i}", "a") for i in range(n)], edge), spark.createDataFrame([("a", "s")], edge))
        p = spark.createDataFrame([("p", True, False)], "id string, inferred boolean, promoted boolean")
        assert rows(folds.promote(p, c), "promoted") == [(crossed,)]


def test_common_directory_and_tree(spark):
    d = spark.createDataFrame([(1, "/a/b/x"), (1, "/a/b/y"), (1, "/a/bc"), (2, "/q/r"), (3, "/a"), (3, "b")], "g int, path string")
    assert rows(paths.directory_of_all(d, ["g"]), "g", "directory") == [(1, "/a"), (2, "/q"), (3, "")]
    t = paths.project_tree(spark.createDataFrame([("/w/a", "a"), ("/w/b/c", "c")], "root_path string, name string"))
    assert rows(t, "relative") == [("a",), ("b/c",)]
    assert rows(paths.tree_children(t), "prefix", "kind", "name") == [("", "dir", "b"), ("", "leaf", "a"), ("b", "leaf", "c")]


def test_display_names(spark):
    d = spark.createDataFrame([("l", "/a/x.md"), ("l", "/b/x.md"), ("l", "/c/.env"), ("m", "/b/x.md")], "l string, path string")
    assert rows(timeline.with_display_names(d, ["l"]), "path", "display") == [("/a/x.md", "x.md"), ("/b/x.md", "x.md"), ("/b/x.md", "x_2.md"), ("/c/.env", ".env")]


def test_retention(spark):
    f = spark.createDataFrame([("a", 1), ("b", 2), ("c", 99)], "id string, last_accessed long")
    e = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "src_id string, dst_id string")
    pins = spark.createDataFrame([("b", "File")], "node_id string, node_type string")
    assert rows(retention.compact(f, e, pins, 10), "app_id", "access_count") == [("x", 1)]
    assert rows(retention.compact(f, e, pins, 10, "all_apps"), "app_id") == [("x",), ("y",)]
    assert rows(retention.survivors(f, e, pins, 10), "id") == [("b",), ("c",)]
    assert retention.purge_cutoff(100 * retention.DAY, 5) == 5


def test_scalars(spark):
    d = spark.createDataFrame([("a, b,c", "a\r\nb\n\n", " 42 ", "3.14", "abc", "1970-01-01T00:00:00+00:00", "Straße  X ")], "c string, l string, i string, f string, b string, t string, n string")
    t = X.apply_transform
    r = d.select(*[e.alias(str(k)) for k, e in enumerate([t("split_comma", F.col("c")), t("split_newline", F.col("l")), t("parse_int", F.col("i")), t("parse_float", F.col("f")), t("parse_int", F.col("b")), t("datetime_to_epoch", F.col("t")), t("epoch_to_datetime", F.lit(0)), t("parse_float", F.lit("1.0d")), X.normalize_name(F.col("n")), t("split_comma", F.lit(None).cast("string"))])]).first()
    assert list(r) == [["a", "b", "c"], ["a", "b", ""], 42, 3.14, None, 0, "1970-01-01T00:00:00+00:00", None, "straße x", []]
    with pytest.raises(KeyError):
        t("no_such", F.lit(1))


def test_similarity(spark):
    s = lambda a, b: spark.range(1).select(X.string_similarity(F.lit(a), F.lit(b))).first()[0]
    assert s("abc", "abc") == 1.0 and s("ABC", "abc") == 0.95 and s("abcde", "xyz") < 0.5 and s("", "") == 1.0


def test_names(spark):
    d = spark.createDataFrame([("https://h/x/repo.git",), ("git@h:o/repo",), ("",)], "u string")
    assert [r[0] for r in d.select(X.repo_name(F.col("u"))).collect()] == ["repo", "repo", None]
    r = spark.range(1).select(X.last_components(F.lit("/a/b/c"), 2), X.sanitize_dirname(F.lit("a b/ü:@")), X.sanitize_dirname(F.lit("")), *X.split_type(F.lit("com.x.Card")), *X.migration_versions(F.lit("1.0.0_to_1.1.0.toml"))).first()
    assert list(r) == ["b/c", "a-b----", "unnamed", "com.x", "Card", "1.0.0", "1.1.0"]


NOTE = [("Note", "title", "string", True, None, False), ("Note", "count", "int", False, None, False), ("Note", "tags", "string[]", False, None, False), ("Note", "score", "float", True, "1.0", False), ("Note", "created", "datetime", False, None, True)]


@pytest.mark.parametrize(("data", "problem"), [('{"title": "t"}', None), ("{}", "required"), ('{"title": "t", "x": 1}', "unknown"), ('{"title": 1}', "mismatch"), ('{"title": "t", "count": 1.5}', "mismatch"), ('{"title": "t", "tags": []}', None), ('{"title": "t", "tags": [null]}', "mismatch"), ('{"title": "t", "tags": ["a"]}', None), ('{"title": "t", "score": 2}', None), ('{"title": "t", "count": null}', None)])
def test_validate(spark, data, problem):
    f = spark.createDataFrame(NOTE, "_type string, field string, kind string, required boolean, default string, immutable boolean")
    d = spark.createDataFrame([(1, "Note", data)], "id int, _type string, data string")
    assert rows(validation.validate(d, f), "problem") == ([(problem,)] if problem else [])


def test_validate_update_and_type(spark):
    f = spark.createDataFrame(NOTE, "_type string, field string, kind string, required boolean, default string, immutable boolean")
    d = spark.createDataFrame([(1, "Note", '{"created": "x"}'), (2, "Other", "{}"), (3, "Note", '{"count": 3}')], "id int, _type string, data string")
    assert rows(validation.validate(d, f, update=True), "id", "problem") == [(1, "immutable"), (2, "type")]


def linked(pairs):
    tops = {}

    def top(x):
        while tops.setdefault(x, x) != x:
            x = tops[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        tops[max(x, y)] = min(x, y)
    return {x: top(x) for x in tops}


def test_duplicates(spark):
    d = spark.createDataFrame([(1, "a@x", "Ann Lee"), (2, "a@x", "Ann Lee"), (3, None, "ann  lee"), (4, "b@x", "Zed"), (5, None, "")], "id long, email string, name string")
    assert linked(rows(dedup.candidates(d, "Person"), "source_id", "target_id")) == {1: 1, 2: 1, 3: 1}
    d = spark.createDataFrame([(1, "e@x", "Alice Smith"), (2, "e@x", "Bob Jones"), (3, "e@x", "Bob Jones")], "id long, email string, name string")
    assert rows(dedup.candidates(d, "Person"), "source_id", "target_id", "score") == [(2, 3, 1.0)]
    t = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id long, name string")
    assert rows(dedup.candidates(t, "Tag"), "source_id", "target_id") == [(1, 2)]


@pytest.mark.parametrize(("kind", "columns"), [("Person", ["email", "name"]), ("Location", ["place_id", "name", "address"]), ("Organization", ["domain", "name"]), ("Tag", ["name"])])
def test_every_exact_pair_is_connected(spark, kind, columns):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7)) + "xyzwvu"[: rng.randrange(7)]
    value = lambda c: None if rng.random() < 0.25 else f"v{rng.randrange(20)}" if c == columns[0] else word()
    data = [(i, *[value(c) for c in columns]) for i in range(120)]
    if kind == "Person":
        data += [(1003, None, ""), (1004, None, " "), (1005, "q", None), (1006, "q", "zz"), (1007, None, None), (1008, None, "Same Name"), (1009, None, "same  name")]
    df = spark.createDataFrame(data, "id long, " + ", ".join(f"{c} string" for c in columns))
    unique, fuzzy, least = dedup.CONFIGS[kind]
    side = lambda i, e: df.select(F.col("id").alias(i), F.struct(*dict.fromkeys([*unique, *fuzzy])).alias(e))
    score, matched = dedup.score("x", "y", unique, fuzzy)
    exact = set(rows(side("i", "x").join(side("j", "y"), F.col("i") < F.col("j")).where((score >= least) & (F.size(matched) > 0)), "i", "j"))
    found = dedup.candidates(df, kind)
    got = set(rows(found, "source_id", "target_id"))
    assert got <= exact and linked(got) == linked(exact) and exact
    if kind == "Person":
        assert dict(rows(dedup.connected(found), "id", "root")) == linked(exact)


def test_merges_follow_chains(spark):
    m = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "source_id string, target_id string")
    assert rows(dedup.keep_map(m), "delete_id", "keep_id") == [("a", "d"), ("b", "d"), ("c", "d")]


def test_masking_and_grants(spark):
    p = spark.createDataFrame([("n", "e", "p", "app")], "name string, email string, phone string, viewer string")
    assert rows(access.mask(p, "Person", F.col("viewer") == "first"), "name", "email", "phone") == [("n", None, None)]
    g = spark.createDataFrame([("a", "read", x) for x in ("system.File.path", "system.File.name", "system.Session", "com.anki.*", "com.anki.Card")], "app string, kind string, entry string")
    assert rows(access.normalise_grants(g), "type", "fields") == [("com.anki.*", None), ("com.anki.Card", None), ("system.File", ["name", "path"]), ("system.Session", None)]
    assert access.readable_fields(["a", "b"], [None]) == ["a", "b"] and access.readable_fields(["a", "b"], []) == []


def test_rate_and_usage(spark):
    r = spark.createDataFrame([("k", 0, i) for i in range(5)], "key string, at long, id long")
    assert [x[1] for x in rows(quota.admit(r, F.lit(2.0)), "id", "admitted")] == [True] * 4 + [False]
    assert all(x[0] for x in rows(quota.admit(r, F.lit(None)), "admitted"))
    q = spark.createDataFrame([("a", i, b) for i, b in enumerate([5, 9, 3, 1, 1])], "app string, order int, bytes int")
    used, limits = spark.createDataFrame([("a", 1, 0)], "app string, entities long, bytes long"), spark.createDataFrame([("a", 4, 10)], "app string, max_entities long, max_bytes long")
    assert [r[1] for r in rows(quota.check_requests(q, used, limits), "order", "reject")] == [None, "storage", None, None, "entities"]
    u = spark.createDataFrame([("a", 1, 1, 500), ("a", 2, 1, 300), ("a", 3, -1, -300), ("b", 1, -1, -9)], "app string, order int, delta int, bytes int")
    assert rows(quota.usage(u), "app", "entities", "bytes") == [("a", 1, 500), ("b", 0, 0)]


def test_requests_are_folded_whole_when_a_join_turns_into_a_broadcast(spark):
    n = 4000
    r = spark.range(n, numPartitions=8).selectExpr("id % 3 as app", "(id * 7919) % 4001 as `order`", "id % 11 as bytes")
    limits = r.groupBy("app").agg(F.lit(200).cast("long").alias("max_entities"), F.lit(600).cast("long").alias("max_bytes"))
    used = r.groupBy("app").agg(F.lit(0).cast("long").alias("entities"), F.lit(0).cast("long").alias("bytes"))
    # sort-merge joins as planned, broadcast ones once sizes are known; parts as many as in a large run
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        got = rows(quota.check_requests(r, used, limits), "app", "order", "reject")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want, state = [], {}
    for app, order, size in sorted((i % 3, i * 7919 % 4001, i % 11) for i in range(n)):
        entities, total = state.get(app, (0, 0))
        reject = "entities" if entities + 1 > 200 else "storage" if total + size > 600 else None
        state[app] = (entities, total) if reject else (entities + 1, total + size)
        want.append((app, order, reject))
    assert len(got) == n and got == sorted(want, key=repr)


def test_import_merge(spark):
    s = "id int, a int, b int, c int, _version int"
    x, i = spark.createDataFrame([(1, 1, 2, None, 3)], s), spark.createDataFrame([(1, 99, None, 3, 1)], s)
    assert rows(lifecycle.import_rows(x, i, "merge"), "id", "a", "b", "c", "_version") == [(1, 99, 2, 3, 3)]


def test_project_detection(spark):
    rows_ = [("/w/a/.git", True, None), ("/w/a/Cargo.toml", False, '[package]\nname = "crate"'), ("/w/b/Cargo.toml", False, '[package]\nname = "crate"'), ("/w/b/sub/.git", True, None), ("/w/node_modules/x/.git", True, None), ("/w/c/d/e/f/.git", True, None), ("/w/p/.project", False, None), ("/w/q/go.mod", False, "module example.org/m/tool\n"), ("/w/r/package.json", False, "{}")]
    d = projects.detect(spark.createDataFrame(rows_, "path string, is_dir boolean, content string"), 3, "/w")
    assert rows(d, "root_path", "signal", "confidence", "name") == [("/w/a", "git", 90, "a"), ("/w/b", "cargo", 80, "crate"), ("/w/p", "explicit", 100, "p"), ("/w/q", "go", 80, "tool")]


def test_prune(spark):
    p = spark.createDataFrame([("live", True), ("dead1", True), ("dead2", False)], "root_path string, inferred boolean")
    assert rows(projects.prune(p, spark.createDataFrame([("live",)], "path string")), "root_path", "outcome") == [("dead1", "deleted"), ("dead2", "archived"), ("live", "alive")]


def test_migration_chain_and_run(spark, tmp_path):
    s = spark.createDataFrame([("1.0.0", "1.1.0"), ("1.1.0", "2.0.0")], "from_version string, to_version string")
    assert rows(migrate.chain(s, "1.0.0", "2.0.0"), "n", "to_version") == [(1, "1.1.0"), (2, "2.0.0")]
    assert rows(migrate.chain(s, "1.0.0", "9.9.9"), "n") == []
    t = str(tmp_path / "t")
    spark.createDataFrame([(1, "7")], "id int, x string").write.parquet(t)
    ops = [{"op": "rename_field", "from": "x", "to": "y"}, {"op": "change_type", "field": "y", "type": "int", "transform": "parse_int"}]
    for _ in range(2):
        assert rows(migrate.run_pending(t, ops, str(tmp_path / "c"), spark.read.parquet), "id", "y") == [(1, 7)]


def test_shedding(spark):
    s = "id string, type string, timestamp long, source string, pid long, payload string"
    full = [(f"r{i}", "file.read", i, "ebpf", i, "") for i in range(3)]
    assert rows(streams.shed(spark.createDataFrame([*full, ("n", "app.action", 9, "x", 1, "p")], s), 3), "id") == [("n",), ("r0",), ("r1",)]
    same = [("a", "window.focused", 100, "wl", 42, "p"), ("b", "window.focused", 200, "wl", 42, "p")]
    assert rows(streams.shed(spark.createDataFrame(same, s), 1), "id", "timestamp") == [("a", 200)]


def test_decode_sets_bad_rows_aside(spark):
    d = spark.createDataFrame([("1", "file.opened", '{"path": "/a", "app_id": "x"}'), ("2", "file.opened", "{oops"), ("3", "other", "x")], "id string, type string, payload string")
    good, bad = decode(d, "file.opened")
    assert rows(good, "id", "path") == [("1", "/a")] and rows(bad, "id") == [("2",)]


def test_export_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, "Person", "a", False), (2, "Tag", "a", True), (3, "Tag", "b", False)], "id int, _type string, _owner string, _deleted boolean")
    export.export(export.select_export(d), str(tmp_path))
    back, off = export.import_entities(spark, str(tmp_path), "id int, _owner string, _deleted boolean, _type string")
    assert rows(back, "id", "_type") == [(1, "Person"), (3, "Tag")] and off.isEmpty()


def test_linked_documents_come_in_parts(spark):
    import json

    d = spark.createDataFrame([(i, "Tag" if i % 3 else None, f'a "{i}"' if i % 5 else None) for i in range(50)], "id int, _type string, name string")
    found = {(r["_type"], r.part): json.loads(r.document) for r in export.linked_documents(d, "https://example.org", "id", 7).collect()}
    for kind in ("Tag", None):
        ids = [i for i in range(50) if (kind if i % 3 else None) == kind and bool(i % 3) == (kind is not None)]
        parts = [found[kind, p] for p in range(-(-len(ids) // 7))]
        assert [x["id"] for p in parts for x in p["@graph"]] == ids and all(len(p["@graph"]) == 7 for p in parts[:-1])
        assert all(p["@context"] == "https://example.org" and p.get("@type") == kind for p in parts)
        assert all(x.get("name") == (f'a "{x["id"]}"' if x["id"] % 5 else None) for p in parts for x in p["@graph"])
    assert len(found) == 5 + 3 and export.linked_documents(d.limit(0), "c", "id").isEmpty()


def test_changes(spark):
    s = "id string, status string, v int"
    b, a = spark.createDataFrame([("1", "active", 1), ("2", "active", 1), ("3", "active", 1)], s), spark.createDataFrame([("1", "active", 1), ("2", "archived", 1), ("3", "active", 2), ("4", "active", 1)], s)
    assert rows(tables.changes(b, a), "id", "change") == [("2", "archived"), ("3", "updated"), ("4", "created")]


def plain_plan(starts, refs):
    reach = {}
    for s in starts:
        seen, todo = {s}, [s]
        while todo:
            x = todo.pop()
            new = [(k, i) for k, i, _, rk, ri, p in refs if p == "cascade" and (rk, ri) == x and (k, i) not in seen]
            seen |= set(new)
            todo += new
        reach[s] = seen
    held = {s for s, seen in reach.items() if any(p == "restrict" and (rk, ri) in seen and (k, i) not in seen for k, i, _, rk, ri, p in refs)}
    gone = set().union(*[seen for s, seen in reach.items() if s not in held])
    return sorted(((*s, "restricted" if s in held else "deleted") for s in starts), key=repr), sorted([(*x, "", "deleted") for x in gone] + [(*x, f, "nullified") for x, f in {((k, i), f) for k, i, f, rk, ri, p in refs if p == "nullify" and (rk, ri) in gone and (k, i) not in gone}], key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_delete_plan_over_circles(spark, seed):
    rng = random.Random(seed)
    refs = [("a", 1, "b", "b", 1, "cascade"), ("b", 1, "c", "c", 1, "cascade"), ("c", 1, "a", "a", 1, "cascade"), ("a", 9, "self", "a", 9, "cascade"), ("a", 9, "self2", "a", 9, "restrict"), ("c", 2, "x", "c", 1, "nullify")]
    refs += [(rng.choice("abc"), rng.randrange(2, 15), f"f{i % 4}", rng.choice("abc"), rng.randrange(2, 15), rng.choice(["cascade"] * 3 + ["restrict", "nullify", "nullify"])) for i in range(40)]
    starts = [("a", 1), ("a", 9), ("b", 3), ("c", 5), ("b", 99)]
    out, effects = lifecycle.delete_plan(spark.createDataFrame(starts, "kind string, id long"), spark.createDataFrame([*refs, ("a", 3, "n", None, None, "cascade")], "kind string, id long, field string, ref_kind string, ref_id long, policy string"))
    want = plain_plan(starts, refs)
    assert rows(out, "kind", "id", "outcome") == want[0]
    assert rows(effects.fillna({"field": ""}), "kind", "id", "field", "effect") == want[1]


def test_counters_are_those_of_the_rows_written(spark, tmp_path):
    d = spark.range(100).withColumn("outcome", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b"))
    assert counters.write_counted(d, str(tmp_path / "out"), ["a", "b", "none"]) == {"a": 34, "b": 33, "none": 0}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100


def test_create_judges_each_row_and_fills_defaults(spark):
    fields = spark.createDataFrame([("n.T", "a", "string", True, None, False), ("n.T", "s", "float", False, "1.5", False), ("n.T", "t", "string", False, 'x"y', False), ("n.T", "g", "string[]", False, '["q"]', False)], "_type string, field string, kind string, required boolean, default string, immutable boolean")
    b = spark.createDataFrame([(1, "n.T", "n", '{"a":"x"}'), (1, "n.T", "n", "{}"), (2, "n.T", "n", ' {"a":"x", "s": 2} '), (3, "n.U", "n", "{}")], "id int, _type string, app string, data string")
    scopes = spark.createDataFrame([("n", "n.T"), ("n", "n.U")], "app string, _type string")
    got = rows(lifecycle.create_checked(b, scopes, fields, F.lit(0)), "id", "reject", "data")
    assert [(i, r) for i, r, _ in got] == [(1, "required"), (1, None), (2, None), (3, "type")]
    data = {(i, r): d for i, r, d in got}
    assert json.loads(data[1, None]) == {"a": "x", "s": 1.5, "t": 'x"y', "g": ["q"]} and json.loads(data[2, None]) == {"a": "x", "s": 2, "t": 'x"y', "g": ["q"]}
    assert data[1, "required"] == "{}"


def test_checked_updates_and_answers(spark):
    fields = spark.createDataFrame([("n.T", "a", "string", True, None, False), ("n.T", "s", "int", False, None, False), ("n.T", "i", "int", False, None, True)], "_type string, field string, kind string, required boolean, default string, immutable boolean")
    now = spark.createDataFrame([(i, "n.T", "n", 2, '{"a":"x","s":1}') for i in range(6)], "id int, _type string, _owner string, _version long, data string")
    ask = spark.createDataFrame([(0, "n", 2, 1, '{"s":5}'), (0, "n", 2, 2, '{"s":6}'), (1, "n", 2, 1, '{"zz":1}'), (2, "n", 2, 1, '{"s":"t"}'), (3, "n", 2, 1, '{"i":1}'), (4, "m", 2, 1, '{"s":7}'), (5, "o", 2, 1, '{"s":7}'), (9, "n", 2, 1, "{}"), (5, "p", 1, 1, "{}")], "id int, app string, expected_version long, order int, data string")
    scopes = spark.createDataFrame([("n", "n.T", "own"), ("m", "n.T", "own"), ("p", "n.T", "all")], "app string, _type string, scope string")
    got = {(r["id"], r["app"], r["order"]): (r["reject"], r["field"], r["data"] and json.loads(r["data"]), r["_version"]) for r in lifecycle.update_checked(now, ask, scopes, fields, F.lit(0)).collect()}
    assert got == {
        (0, "n", 1): (None, None, {"a": "x", "s": 5}, 3), (0, "n", 2): ("version", None, None, None), (1, "n", 1): ("unknown", "zz", None, None), (2, "n", 1): ("mismatch", "s", None, None), (3, "n", 1): ("immutable", "i", None, None),
        (4, "m", 1): ("owner", None, None, None), (5, "o", 1): ("scope", None, None, None), (9, "n", 1): ("missing", None, None, None), (5, "p", 1): ("version", None, None, None),
    }
    t = spark.createDataFrame([(1, "n.T", "n", 2, True), (2, "n.T", "n", 2, False)], "id int, _type string, _owner string, _version long, _deleted boolean").withColumns({"_deleted_at": F.lit(None).cast("int"), "_modified_at": F.lit(None).cast("int")})
    asked = spark.createDataFrame([(1, "n.T", "n"), (1, "n.T", "n"), (2, "n.T", "x"), (7, "n.T", "n")], "id int, _type string, app string")
    after, said = lifecycle.answered(t, asked, scopes, True, F.lit(5))
    assert rows(after, "id", "_version", "_deleted", "_modified_at") == [(1, 3, False, 5), (2, 2, False, None)]
    assert rows(said, "id", "reject") == [(1, None), (1, None), (2, "not_deleted"), (7, "missing")]
