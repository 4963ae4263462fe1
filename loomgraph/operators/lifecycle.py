"""Bulk life of entities: create, update, trash, restore, uninstall, cleanup, references, import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.validation import validate

RESERVED = ("id", "_type", "_owner", "_version", "_created_at", "_modified_at", "_deleted", "_deleted_at")


def apply_deleted(entities: DataFrame, mode: str = "exclude") -> DataFrame:
    """exclude (default), only, or all."""
    gone = F.coalesce("_deleted", F.lit(False))
    return {"exclude": lambda: entities.where(~gone), "only": lambda: entities.where(gone), "all": lambda: entities}[mode]()


def trash(entities: DataFrame, owner: str, entity_type: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of an owner's trash, the newest deletion first, ties by id."""
    d = apply_deleted(entities, "only").where(F.col("_owner") == owner)
    if entity_type:
        d = d.where(F.col("_type") == entity_type)
    return d.orderBy(F.desc("_deleted_at"), "id").offset(offset).limit(limit)


def trash_summary(entities: DataFrame) -> DataFrame:
    """Deleted rows by type, and in all (type null)."""
    return apply_deleted(entities, "only").rollup("_type").agg(F.count("*").alias("n"))


def expired_trash(entities: DataFrame, retention: DataFrame, now: Column, default_days: int = 30) -> DataFrame:
    """Deleted rows older than their type's retention (_type, days), or than the default."""
    d = apply_deleted(entities, "only").join(retention, "_type", "left")
    return d.where(F.col("_deleted_at") < now - F.make_dt_interval(days=F.coalesce("days", F.lit(default_days)))).drop("days")


def mark_pending(entities: DataFrame, owners: DataFrame, now: Column) -> DataFrame:
    hit = entities.join(owners.select("_owner").distinct().withColumn("__hit", F.lit(True)), "_owner", "left")
    return hit.withColumn("_pending_delete", F.coalesce("__hit", F.lit(False)) | F.coalesce("_pending_delete", F.lit(False))).withColumn("_pending_delete_at", F.when(F.col("__hit"), now).otherwise(F.col("_pending_delete_at"))).drop("__hit")


def unmark_pending(entities: DataFrame, owners: DataFrame) -> DataFrame:
    hit = entities.join(owners.select("_owner").distinct().withColumn("__hit", F.lit(True)), "_owner", "left")
    out = {c: F.when(F.col("__hit").isNull(), F.col(c)) for c in ("_pending_delete", "_pending_delete_at")}
    return hit.withColumns(out).drop("__hit")


def expired_pending(entities: DataFrame, now: Column, grace_days: int) -> DataFrame:
    return entities.where(F.coalesce("_pending_delete", F.lit(False)) & (F.col("_pending_delete_at") < now - F.make_dt_interval(days=F.lit(grace_days)))).select("id", "_type")


def _first(reasons: list[tuple[Column, str]]) -> Column:
    """The first reason that holds, else null."""
    out = F.lit(None).cast("string")
    for hit, name in reversed(reasons):
        out = F.when(F.coalesce(hit, F.lit(False)), name).otherwise(out)
    return out


def create(batch: DataFrame, scopes: DataFrame, known: DataFrame, required: list[str], defaults: dict[str, object], now: Column) -> DataFrame:
    """batch (id, _type, app, fields) with reject (scope, namespace, type, required) and, for accepted rows, the reserved columns and defaults.

    scopes: (app, _type) an app may write. A type belongs to an app if it starts with its id and a dot; `system` types are free.
    """
    d = batch.join(scopes.select("app", "_type").distinct().withColumn("__scope", F.lit(True)), ["app", "_type"], "left")
    d = d.join(known.select("_type").distinct().withColumn("__known", F.lit(True)), "_type", "left")
    missing = [F.col(c).isNull() for c in required if c not in defaults]
    reject = _first([
        (F.col("__scope").isNull(), "scope"),
        (~(F.col("_type").startswith("system.") | F.expr("startswith(_type, concat(app, '.'))")), "namespace"),
        (F.col("__known").isNull(), "type"),
        *[(m, "required") for m in missing],
    ])
    d = d.withColumn("reject", reject).withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
    ok = F.col("reject").isNull()
    return d.withColumns({"_version": F.when(ok, F.lit(1).cast("bigint")), "_owner": F.when(ok, F.col("app")), "_created_at": F.when(ok, now), "_modified_at": F.when(ok, now), "_deleted": F.when(ok, F.lit(False))}).drop("__scope", "__known")


def create_checked(batch: DataFrame, scopes: DataFrame, fields: DataFrame, now: Column) -> DataFrame:
    """batch (id, _type, app, data as JSON) with reject and field, the first of scope, namespace and what validation finds (type, required, unknown, mismatch), and the reserved columns of accepted rows.

    scopes: (app, _type) an app may write; fields: the declared types, as for validation. Each row is judged by its own type and data,
    whatever other rows have its id. Accepted rows get the declared defaults of fields that they don't give.
    """
    content = F.to_json(F.struct("_type", "data"), {"ignoreNullFields": "false"})
    rows = batch.withColumn("__content", content)
    found = validate(rows.select(F.col("__content").alias("id"), "_type", "data").distinct(), fields).withColumnRenamed("id", "__content")
    d = rows.join(scopes.select("app", "_type").distinct().withColumn("__scope", F.lit(True)), ["app", "_type"], "left").join(found, "__content", "left").drop("__content")
    own = F.col("_type").startswith("system.") | F.expr("startswith(_type, concat(app, '.'))")
    reject = _first([(F.col("__scope").isNull(), "scope"), (~own, "namespace")])
    d = d.withColumns({"field": F.when(reject.isNull(), F.col("field")), "reject": F.coalesce(reject, F.col("problem"))})
    ok = F.col("reject").isNull()
    text = ~F.col("kind").isin("int", "float", "bool", "json") & ~F.col("kind").endswith("[]")
    value = F.when(text, F.to_json(F.array("default"))).otherwise(F.concat(F.lit("["), "default", F.lit("]")))  # in brackets: to_json takes no bare text
    pair = F.struct("field", F.concat(F.lit('"'), "field", F.lit('":'), F.expr("substring(v, 2, length(v) - 2)")).alias("json"))
    defaults = fields.where("default is not null").withColumn("v", value).groupBy("_type").agg(F.array_sort(F.collect_list(pair)).alias("__defaults"))
    d = d.join(defaults, "_type", "left")
    added = F.filter("__defaults", lambda x: ~F.array_contains(F.coalesce(F.json_object_keys("data"), F.array().cast("array<string>")), x["field"]))
    body = F.regexp_extract("data", r"(?s)^\s*\{(.*)\}\s*$", 1)
    own = F.when(F.trim(body) == "", F.array().cast("array<string>")).otherwise(F.array(body))
    d = d.withColumn("data", F.when(ok & (F.size(added) > 0), F.concat(F.lit("{"), F.array_join(F.concat(own, F.transform(added, lambda x: x["json"])), ","), F.lit("}"))).otherwise(F.col("data"))).drop("__defaults")
    return d.withColumns({"_version": F.when(ok, F.lit(1).cast("bigint")), "_owner": F.when(ok, F.col("app")), "_created_at": F.when(ok, now), "_modified_at": F.when(ok, now), "_deleted": F.when(ok, F.lit(False))}).drop("__scope", "problem")


def update_checked(current: DataFrame, changes: DataFrame, scopes: DataFrame, fields: DataFrame, now: Column) -> DataFrame:
    """changes (id, app, expected_version, order, data as JSON) against current (id, _type, _owner, _version, data): one row each, with reject and field, or the new data and version.

    reject, in this order: missing, scope, owner, version, then what validation of an update finds: immutable, unknown, mismatch.
    scopes: (app, _type, scope), scope `all` or `own`. Accepted fields replace those of the row, the others stay. Of changes that expect
    one version of an id the earliest wins.
    """
    c = current.select("id", "_type", F.struct("_owner", "_version", "data").alias("cur"))
    d = changes.drop("_type").join(c, "id", "left").join(scopes.select("app", "_type", F.col("scope").alias("__scope")), ["app", "_type"], "left")
    content = F.to_json(F.struct("_type", "data"), {"ignoreNullFields": "false"})
    d = d.withColumn("__content", content)
    found = validate(d.select(F.col("__content").alias("id"), "_type", "data").distinct(), fields, update=True).withColumnRenamed("id", "__content")
    d = d.join(found, "__content", "left").drop("__content")
    n = F.row_number().over(Window.partitionBy("id", "expected_version").orderBy("order"))
    reject = _first([
        (F.col("cur").isNull(), "missing"), (F.col("__scope").isNull(), "scope"), ((F.col("__scope") == "own") & (F.col("cur._owner") != F.col("app")), "owner"),
        ((F.col("expected_version") != F.col("cur._version")) | (F.col("n") > 1), "version"),
    ])
    d = d.withColumn("n", n).withColumn("reject", reject)
    d = d.withColumns({"field": F.when(F.col("reject").isNull(), F.col("field")), "reject": F.coalesce("reject", "problem")})
    ok = F.col("reject").isNull()
    old, new = (F.from_json(x, "map<string,variant>") for x in ("cur.data", "data"))
    merged = F.to_json(F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new))
    return d.withColumns({"data": F.when(ok, merged), "_version": F.when(ok, F.col("cur._version") + 1), "_modified_at": F.when(ok, now)}).drop("cur", "n", "__scope", "problem")


def answers(requests: DataFrame, current: DataFrame, scopes: DataFrame, deleted: bool) -> DataFrame:
    """requests (id, _type, app) of soft deletes (deleted: False, what must not yet be) or restores (True) with reject: missing, scope, owner, or deleted / not_deleted.

    scopes: (app, _type, scope): types an app may write, and whether `all` rows or its `own` only. Every request has its answer.
    """
    d = requests.join(scopes.select("app", "_type", F.col("scope").alias("__scope")), ["app", "_type"], "left")
    d = d.join(current.select("id", F.col("_owner").alias("__owner"), F.coalesce("_deleted", F.lit(False)).alias("__deleted")), "id", "left")
    state = (F.col("__deleted") != F.lit(deleted), "not_deleted" if deleted else "deleted")
    rights = [(F.col("__scope").isNull(), "scope"), ((F.col("__scope") == "own") & (F.col("__owner") != F.col("app")), "owner")]
    reject = _first([(F.col("__deleted").isNull(), "missing"), *([state, *rights] if deleted else [*rights, state])])
    return d.withColumn("reject", reject).drop("__scope", "__owner", "__deleted")


def answered(current: DataFrame, requests: DataFrame, scopes: DataFrame, deleted: bool, now: Column) -> tuple[DataFrame, DataFrame]:
    """The table after all requests (id, _type, app) that `answers` lets through, and the answers: soft deletes, or with deleted=True restores, one version on.

    Requests for one id that may go through have one effect.
    """
    said = answers(requests, current, scopes, deleted)
    d = current.join(said.where("reject is null").select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    hit = F.coalesce("__hit", F.lit(False))
    if deleted:
        new = {"_version": F.col("_version") + hit.cast("bigint"), "_modified_at": F.when(hit, now).otherwise(F.col("_modified_at")), "_deleted_at": F.when(~hit, F.col("_deleted_at")), "_deleted": F.coalesce("_deleted", F.lit(False)) & ~hit}
    else:
        new = {"_deleted_at": F.when(hit, now).otherwise(F.col("_deleted_at")), "_deleted": F.coalesce("_deleted", F.lit(False)) | hit}
    return d.withColumns(new).drop("__hit"), said


def update(current: DataFrame, changes: DataFrame, immutable: list[str], fields: list[str], now: Column, scopes: DataFrame | None = None) -> DataFrame:
    """changes (id, app, expected_version, order, fields) against current: one row each, with reject (scope, missing, owner, version, immutable) or the new row.

    scopes: (app, _type) an app may write, for changes with a column _type; without it all may. Of changes that expect one version of an id the earliest wins; the others meet a version that has moved on.
    """
    c = current.select("id", F.struct("_owner", "_version", *fields).alias("cur"))
    d = changes.join(c, "id", "left")
    denied = F.lit(False)
    if scopes is not None:
        d = d.join(scopes.select("app", "_type").distinct().withColumn("__scope", F.lit(True)), ["app", "_type"], "left")
        denied = F.col("__scope").isNull()
    n = F.row_number().over(Window.partitionBy("id", "expected_version").orderBy("order"))
    given = [F.col(f).isNotNull() & ~F.col(f).eqNullSafe(F.col(f"cur.{f}")) for f in immutable]
    reject = _first([
        (denied, "scope"),
        (F.col("cur").isNull(), "missing"),
        (F.col("cur._owner") != F.col("app"), "owner"),
        ((F.col("expected_version") != F.col("cur._version")) | (F.col("n") > 1), "version"),
        *[(g, "immutable") for g in given],
    ])
    d = d.withColumn("n", n).withColumn("reject", reject)
    ok = F.col("reject").isNull()
    new = {f: F.when(ok, F.coalesce(F.col(f), F.col(f"cur.{f}"))) for f in fields}
    return d.withColumns({**new, "_version": F.when(ok, F.col("cur._version") + 1), "_modified_at": F.when(ok, now)}).drop("cur", "n", "__scope")


def soft_delete(current: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """current with requests (id, app) applied: rows of the app that aren't deleted yet; reject tells why not."""
    d = current.join(requests.select("id", "app"), "id", "left")
    asked = F.col("app").isNotNull()
    reject = _first([(asked & (F.col("_owner") != F.col("app")), "owner"), (asked & F.col("_deleted"), "deleted")])
    d = d.withColumn("reject", reject).withColumn("__hit", asked & F.col("reject").isNull())
    return d.withColumns({"_deleted_at": F.when(F.col("__hit"), now).otherwise(F.col("_deleted_at")), "_deleted": F.col("_deleted") | F.col("__hit")}).drop("__hit", "app")


def restore(current: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """current with requests (id, app) applied: deleted rows of the app come back one version on."""
    d = current.join(requests.select("id", "app"), "id", "left")
    asked = F.col("app").isNotNull()
    reject = _first([(asked & ~F.col("_deleted"), "not_deleted"), (asked & (F.col("_owner") != F.col("app")), "owner")])
    d = d.withColumn("reject", reject).withColumn("__hit", asked & F.col("reject").isNull())
    hit = F.col("__hit")
    return d.withColumns({"_version": F.col("_version") + hit.cast("bigint"), "_modified_at": F.when(hit, now).otherwise(F.col("_modified_at")), "_deleted_at": F.when(~hit, F.col("_deleted_at")), "_deleted": F.col("_deleted") & ~hit}).drop("__hit", "app")


def delete_for_good(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the given ids."""
    gone = ids.select("id").distinct()
    return nodes.join(gone, "id", "left_anti"), edges.join(gone.withColumnRenamed("id", "src_id"), "src_id", "left_anti").join(gone.withColumnRenamed("id", "dst_id"), "dst_id", "left_anti")


def orphan_references(edges: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """Edges to soft-deleted nodes."""
    gone = apply_deleted(nodes, "only").select(F.col("id").alias("dst_id"))
    return edges.join(gone, "dst_id", "left_semi").select("src_id", F.lit(kind).alias("relation"), "dst_id")


def dangling_references(rows: DataFrame, columns: list[str], targets: DataFrame) -> DataFrame:
    """(id, field, target) of reference columns whose target isn't there."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("target")) for c in columns]))
    d = rows.select("id", pairs.alias("r")).select("id", "r.*").where("target is not null")
    return d.join(targets.select(F.col("id").cast("string").alias("target")).distinct(), "target", "left_anti").select("id", "field", "target")


def missing_schemas(entities: DataFrame, schemas: DataFrame) -> DataFrame:
    return entities.select("_type").distinct().join(schemas.select("_type"), "_type", "left_anti")


def nullify(rows: DataFrame, field: str, targets: DataFrame) -> DataFrame:
    """rows with a reference field emptied where its target is among the removed ids."""
    t = targets.select(F.col("id").alias(field)).distinct().withColumn("__gone", F.lit(True))
    return rows.join(t, field, "left").withColumn(field, F.when(F.col("__gone").isNull(), F.col(field))).drop("__gone")


def cascade(start: DataFrame, references: list[tuple[str, DataFrame]]) -> DataFrame:
    """(level, id) of rows that go with start, through references (name, (id, ref)) from one table to the one before."""
    out = start.select(F.lit("0").alias("level"), F.col("id").cast("string").alias("id")).distinct()
    frontier = start.select("id").distinct()
    for name, rows in references:
        frontier = rows.join(frontier.select(F.col("id").alias("ref")), "ref", "left_semi").select("id").distinct()
        out = out.unionByName(frontier.select(F.lit(name).alias("level"), F.col("id").cast("string").alias("id")))
    return out


def delete_plan(starts: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, effects) of deletions asked for (kind, id), through references of all tables, which may go round in circles.

    references: (kind, id, field, ref_kind, ref_id, policy): a row and what one of its fields refers to; policy cascade, restrict or
    nullify. Each start takes along all rows that reach it by cascade; if a row outside of these refers to one of them by
    restrict, the start is restricted and nothing of it happens. outcomes: (kind, id, outcome), deleted or restricted. effects:
    (kind, id, field, effect): rows deleted, and fields nullified of rows that stay. The frontier is followed until no new row comes,
    so rounds are the longest way, not the number of rows. Needs a checkpoint folder.
    """
    named = references.select("kind", "id", "field", "ref_kind", "ref_id", "policy").where("ref_id is not null")
    by = lambda policy: named.where(F.col("policy") == policy)
    start, cascade = F.struct("kind", "id"), by("cascade").checkpoint()  # read once, not in every round
    reach = starts.select(start.alias("start"), "kind", "id").distinct().checkpoint()
    frontier = reach
    while not frontier.isEmpty():
        step = cascade.join(frontier.select("start", F.col("kind").alias("ref_kind"), F.col("id").alias("ref_id")), ["ref_kind", "ref_id"])
        frontier = step.select("start", "kind", "id").distinct().join(reach, ["start", "kind", "id"], "left_anti").checkpoint()
        reach = reach.unionByName(frontier)
    held = by("restrict").join(reach.select("start", F.col("kind").alias("ref_kind"), F.col("id").alias("ref_id")), ["ref_kind", "ref_id"])
    held = held.join(reach, ["start", "kind", "id"], "left_anti").select("start").distinct().withColumn("held", F.lit(True))
    outcomes = starts.select("kind", "id").distinct().join(held.select("start.*", "held"), ["kind", "id"], "left")
    outcomes = outcomes.select("kind", "id", F.when(F.col("held"), "restricted").otherwise("deleted").alias("outcome"))
    gone = reach.join(held, "start", "left_anti").select("kind", "id").distinct().checkpoint()
    emptied = by("nullify").join(gone.select(F.col("kind").alias("ref_kind"), F.col("id").alias("ref_id")), ["ref_kind", "ref_id"], "left_semi").join(gone, ["kind", "id"], "left_anti")
    effects = gone.select("kind", "id", F.lit(None).cast("string").alias("field"), F.lit("deleted").alias("effect"))
    return outcomes, effects.unionByName(emptied.select("kind", "id", "field", F.lit("nullified").alias("effect")).distinct())


def restricted(start: DataFrame, rows: DataFrame) -> DataFrame:
    """Ids of start that some row still refers to (column ref), so that they may not go."""
    return start.join(rows.select(F.col("ref").alias("id")), "id", "left_semi").select("id")


def import_rows(existing: DataFrame, imported: DataFrame, mode: str) -> DataFrame:
    """The table after an import: outcome and columns of each id. mode: skip, replace, or merge (given fields win, reserved ones stay)."""
    columns = [c for c in existing.columns if c != "id"]
    e, i = existing.select("id", F.struct(*columns).alias("e")), imported.select("id", F.struct(*columns).alias("i"))
    both = F.col("e").isNotNull() & F.col("i").isNotNull()
    pick = []
    for c in columns:
        old, new = F.col(f"e.{c}"), F.col(f"i.{c}")
        kept = {"skip": old, "replace": new, "merge": old if c in RESERVED or c.startswith("_") else F.coalesce(new, old)}[mode]
        pick.append(F.when(both, kept).when(F.col("e").isNotNull(), old).otherwise(new).alias(c))
    outcome = F.when(F.col("i").isNull(), "kept").when(F.col("e").isNull(), "inserted").otherwise({"skip": "skipped", "replace": "replaced", "merge": "merged"}[mode])
    return e.join(i, "id", "full_outer").select("id", outcome.alias("outcome"), *pick)


def outcome_counts(rows: DataFrame, column: str = "outcome") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def cleanup(entities: DataFrame, edges: DataFrame, rows: DataFrame, field: str, retention: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One cleanup: expired trash goes for good with its edges, references to it are emptied. Returns entities, edges, rows and counts by action."""
    gone = expired_trash(entities, retention, now).select("id")
    nodes, kept = delete_for_good(entities, edges, gone)
    hit = rows.join(gone.select(F.col("id").alias(field)).distinct(), field, "left_semi")
    counts = gone.select(F.lit("deleted").alias("outcome")).unionByName(hit.select(F.lit("nullified").alias("outcome")))
    return nodes, kept, nullify(rows, field, gone), outcome_counts(counts)
