"""Validation of entities, of their declarations and of project configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scalars import is_hex_color, is_pascal_case, is_snake_case

#: Names that declarations may not take; a namespace that nobody and one that only first parties may declare in.
RESERVED_FIELDS = ["id", "_version", "_owner", "_created_at", "_modified_at", "_deleted", "_deleted_at", "_pending_delete"]
RESERVED_ENTITIES = ["File", "App", "Session", "Project", "UserAction", "Notification", "Person", "Organization", "Event", "Location", "Tag", "Entity", "Node", "Edge", "Relation", "Schema"]
CLOSED_NAMESPACE, SHARED_NAMESPACE = "system", "shared"
#: Fixed values of project configurations: states, issue trackers, scopes of context, what is left out of a project's files.
STATES = ["active", "archived"]
PROVIDERS = ["github-issues", "gitlab-issues", "openproject", "plane", "jira"]
CONTEXT_SCOPES = ["minimal", "project", "time-scoped"]
EXCLUDED = ["node_modules", "target", ".git", "dist", "build", "__pycache__", "*.pyc", ".next", "vendor"]


def fits(kind: Column, is_null: Column, required: Column, value: Column, declared: Column) -> Column:
    """Whether a value of a VARIANT kind fits a declared type: integers must be whole, lists of one kind, null only if not required."""
    text = declared.isin("string", "text", "datetime", "date", "duration", "url", "email", "path", "markdown", "color", "bytes", "uuid") | declared.startswith("ref:")
    number = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
    empty = (kind == "ARRAY<VOID>") & (F.size(F.coalesce(F.expr("try_variant_get(value, '$', 'array<variant>')"), F.array().cast("array<variant>"))) == 0)
    ok = (
        F.when(is_null | (kind == "VOID"), ~required)
        .when(declared == "json", True)
        .when(text, kind == "STRING")
        .when(declared == "int", kind == "BIGINT")
        .when(declared == "float", number)
        .when(declared == "bool", kind == "BOOLEAN")
        .when(declared == "string[]", (kind == "ARRAY<STRING>") | empty)
        .when(declared == "int[]", (kind == "ARRAY<BIGINT>") | empty)
        .when(declared == "float[]", (kind == "ARRAY<BIGINT>") | (kind == "ARRAY<DOUBLE>") | kind.startswith("ARRAY<DECIMAL") | empty)
        .when(declared == "bool[]", (kind == "ARRAY<BOOLEAN>") | empty)
        .otherwise(False)
    )
    return ok


def validate(rows: DataFrame, fields: DataFrame, update: bool = False) -> DataFrame:
    """(id, problem, field): the first problem of each row of (id, _type, data as JSON text), in the order type, required (create) or immutable (update), unknown, mismatch.

    fields: (_type, field, kind, required, default, immutable) of all declared types.
    """
    d = rows.select("id", "_type", F.try_parse_json("data").alias("v"))
    f = fields.select("_type", "field", "kind", F.coalesce("required", F.lit(False)).alias("required"), F.col("default").isNotNull().alias("has_default"), F.coalesce("immutable", F.lit(False)).alias("immutable"))
    types = f.select("_type").distinct().withColumn("known", F.lit(True))
    no_type = d.join(types, "_type", "left").where("known is null").select("id", F.lit(0).alias("rank"), F.lit("type").alias("problem"), F.lit(None).cast("string").alias("field"))
    given = d.select("id", "_type", F.explode(F.expr("try_variant_get(v, '$', 'map<string,variant>')")).alias("field", "value"))
    declared = d.join(f, "_type").join(given.select("id", "field", "value").withColumn("given", F.lit(True)), ["id", "field"], "left")
    if update:
        first = declared.where("given and immutable").select("id", F.lit(1).alias("rank"), F.lit("immutable").alias("problem"), "field")
    else:
        first = declared.where("required and not has_default and given is null").select("id", F.lit(1).alias("rank"), F.lit("required").alias("problem"), "field")
    unknown = given.join(types, "_type", "left_semi").join(f.select("_type", "field"), ["_type", "field"], "left_anti").select("id", F.lit(2).alias("rank"), F.lit("unknown").alias("problem"), "field")
    kind = F.schema_of_variant("value")
    bad = declared.where("given").where(~fits(kind, F.col("value").isNull(), F.col("required"), F.col("value"), F.col("kind"))).select("id", F.lit(3).alias("rank"), F.lit("mismatch").alias("problem"), "field")
    every = no_type.unionByName(first).unionByName(unknown).unionByName(bad)
    return every.groupBy("id").agg(F.min(F.struct("rank", "field", "problem")).alias("m")).select("id", "m.problem", "m.field")


def lint(declarations: DataFrame, first_party: list[str], reserved_entities: list[str] = RESERVED_ENTITIES) -> DataFrame:
    """(namespace, entity, field, problem) of declarations that break the naming rules; first-party owners may use the shared namespace, nobody the closed one."""
    c = F.col
    rules = [
        ((c("namespace") == CLOSED_NAMESPACE) | ((c("namespace") == SHARED_NAMESPACE) & ~c("owner").isin(first_party)), "reserved_namespace"),
        (c("entity").isin(reserved_entities), "reserved_entity"),
        (~is_pascal_case(c("entity")), "entity_case"),
        (c("field").isin(RESERVED_FIELDS), "reserved_field"),
        (c("field").isNotNull() & ~c("field").isin(RESERVED_FIELDS) & ~is_snake_case(c("field")), "field_case"),
    ]
    found = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for hit, name in rules]))
    return declarations.select("namespace", "entity", "field", F.explode(found).alias("problem"))


def relation_ends(relations: DataFrame, known: DataFrame) -> DataFrame:
    """(relation, end, type) of relation ends whose type is declared neither as such, nor under the relation's namespace."""
    ends = relations.select("namespace", "relation", F.explode(F.create_map(F.lit("from"), F.col("from_type"), F.lit("to"), F.col("to_type"))).alias("end", "type"))
    k = known.select(F.col("_type").alias("full")).distinct()
    d = ends.join(k.select(F.col("full").alias("type")), "type", "left_anti").withColumn("full", F.concat_ws(".", "namespace", "type"))
    return d.join(k, "full", "left_anti").select("relation", "end", "type")


def duplicates_of(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Values that a unique field holds more than once."""
    return rows.where(" and ".join(f"{c} is not null" for c in columns)).groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def cardinality(edges: DataFrame, kind: str) -> DataFrame:
    """(side, id, n) of ends with more edges than the declared kind (one_to_one, one_to_many, many_to_one, many_to_many) lets them have."""
    e = edges.select("src_id", "dst_id").distinct()
    parts = []
    if kind in ("one_to_one", "many_to_one"):
        parts.append(e.groupBy(F.lit("src").alias("side"), F.col("src_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1"))
    if kind in ("one_to_one", "one_to_many"):
        parts.append(e.groupBy(F.lit("dst").alias("side"), F.col("dst_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1"))
    if not parts:
        return e.select(F.lit("src").alias("side"), F.col("src_id").alias("id"), F.lit(0).cast("bigint").alias("n")).limit(0)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("src_id", "dst_id").unionByName(edges.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"))).distinct()


def check_config(configs: DataFrame) -> DataFrame:
    """configs with problem: the first rule that a project's configuration breaks, else null."""
    rules = [
        (F.length(F.trim(F.coalesce("name", F.lit("")))) == 0, "name"),
        (F.col("status").isNotNull() & ~F.col("status").isin(STATES), "status"),
        (F.col("accent_color").isNotNull() & ~is_hex_color(F.col("accent_color")), "accent_color"),
        (F.col("provider").isNotNull() & ~F.col("provider").isin(PROVIDERS), "provider"),
        (F.col("context_scope").isNotNull() & ~F.col("context_scope").isin(CONTEXT_SCOPES), "context_scope"),
    ]
    out = F.lit(None).cast("string")
    for hit, name in reversed(rules):
        out = F.when(hit, name).otherwise(out)
    return configs.withColumn("problem", out)


def config_defaults(configs: DataFrame) -> DataFrame:
    """configs with missing settings filled in; dates, which may be given as such or as text, become text (yyyy-MM-dd)."""
    exclude = F.array(*[F.lit(x) for x in EXCLUDED])
    none = F.array().cast("array<string>")
    fill = {"id": F.uuid(), "status": F.lit("active"), "root": F.lit("."), "include": none, "exclude": exclude, "context_scope": F.lit("project"), "include_files": none, "default_branch": F.lit("main")}
    d = configs.withColumns({c: F.coalesce(F.col(c), v) if c in configs.columns else v for c, v in fill.items()})
    return d.withColumns({c: F.col(c).cast("string") if c in configs.columns else F.lit(None).cast("string") for c in ("description", "created", "due")})


def type_catalogue(declarations: DataFrame, system: list[str]) -> DataFrame:
    """(type, fields) of all types, the system's and the declared ones (namespace, entity, field), with their numbers of fields."""
    own = declarations.groupBy(F.concat_ws(".", "namespace", "entity").alias("type")).agg(F.countDistinct("field").alias("fields"))
    names = own.sparkSession.createDataFrame([(f"{CLOSED_NAMESPACE}.{x}",) for x in system], "type string")
    return own.unionByName(names.withColumn("fields", F.lit(0).cast("bigint")).join(own, "type", "left_anti"))


def types_known(wanted: DataFrame, catalogue: DataFrame) -> DataFrame:
    """wanted (type, ...) with known: whether the catalogue has the type."""
    return wanted.join(catalogue.select("type").distinct().withColumn("known", F.lit(True)), "type", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def integrity(issues: dict[str, DataFrame]) -> DataFrame:
    """(kind, n) of all issue tables."""
    out = None
    for kind, d in issues.items():
        n = d.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = n if out is None else out.unionByName(n)
    return out
