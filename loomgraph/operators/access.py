"""Access scopes, masking of sensitive columns, grants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENSITIVE = {"Person": ["email", "phone"]}


def prefixes(c: Column) -> Column:
    """`a.b.C` -> [a.b.C, a.b.*, a.*]: the patterns that let a type through."""
    parts = F.split(c, r"\.")
    wide = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "."), F.lit(".*")))
    return F.when(F.size(parts) > 1, F.array_union(F.array(c), wide)).otherwise(F.array(c))


def allowed_types(types: DataFrame, grants: DataFrame) -> DataFrame:
    """(app, _type) that a pattern of grants (app, pattern) covers: by equality with the type's own patterns, not by comparing all pairs."""
    d = types.select("_type").distinct().select("_type", F.explode(prefixes(F.col("_type"))).alias("pattern"))
    return d.join(grants.select("app", "pattern").distinct(), "pattern").select("app", "_type").distinct()


def readable(entities: DataFrame, grants: DataFrame, app: str) -> DataFrame:
    """Entities that an app may see: of granted types, and of scope 'own' its own rows only."""
    g = grants.where(F.col("app") == app)
    d = entities.select("_type").distinct().select("_type", F.explode(prefixes(F.col("_type"))).alias("pattern"))
    scope = d.join(g, "pattern").groupBy("_type").agg(F.max(F.col("scope") == "all").alias("all_rows"))
    return entities.join(scope, "_type").where(F.col("all_rows") | (F.col("_owner") == app)).drop("all_rows")


def readable_fields(declared: list[str], scopes: list[list[str] | None]) -> list[str]:
    """Columns of the first scope that speaks for the type; None means all, no scope none."""
    return [] if not scopes else declared if scopes[0] is None else [c for c in declared if c in scopes[0]]


def mask(entities: DataFrame, entity_type: str, see: Column) -> DataFrame:
    return entities.withColumns({c: F.when(see, F.col(c)) for c in SENSITIVE.get(entity_type, []) if c in entities.columns})


def mask_by_grants(entities: DataFrame, entity_type: str, viewer: str, grants: DataFrame, first: Column, strict: bool = False) -> DataFrame:
    """entities with the sensitive fields of a shared type emptied for viewers (a column) that may not see them.

    First parties see all; others need a grant (app, pattern, exclude) for the type or for all shared ones. strict: a grant speaks for
    no field that it excludes; otherwise any grant shows all.
    """
    fields = [c for c in SENSITIVE.get(entity_type, []) if c in entities.columns]
    shown = F.array_except(F.array(*[F.lit(c) for c in fields]), F.coalesce("exclude", F.array().cast("array<string>"))) if strict else F.array(*[F.lit(c) for c in fields])
    g = grants.where(F.col("pattern").isin(f"shared.{entity_type}", "shared.*")).select(F.col("app").alias("__viewer"), F.explode(shown).alias("__field"))
    g = g.groupBy("__viewer").agg(F.collect_set("__field").alias("__shown"))  # the type's fields at most
    d = entities.join(g, F.col(viewer) == F.col("__viewer"), "left")
    see = lambda c: first | F.coalesce(F.array_contains("__shown", c), F.lit(False))
    return d.withColumns({c: F.when(see(c), F.col(c)) for c in fields}).drop("__viewer", "__shown")


def first_party(app: Column, listed: list[str], prefix: str) -> Column:
    return app.isin(listed) | app.startswith(prefix)


def normalise_grants(grants: DataFrame, legacy: bool = False) -> DataFrame:
    """(app, kind, type, fields) of dotted entries: two names or a wildcard give the whole type, a third name one field; the whole type takes its fields in.

    legacy: a third name is a field always; otherwise a capitalised one is the type.
    """
    parts = F.split("entry", r"\.", 3)
    last = F.element_at(F.split("entry", r"\."), -1)
    field = (F.size(parts) == 3) & (last != "*")
    if not legacy:
        field = field & ~last.rlike(r"^\p{Lu}")
    kind = F.when(field & F.lit(legacy), F.array_join(F.slice(parts, 1, 2), ".")).when(field, F.regexp_extract("entry", r"^(.*)\.[^.]+$", 1)).otherwise(F.col("entry"))
    name = F.when(field, F.get(parts, 2) if legacy else last)
    d = grants.select("app", "kind", kind.alias("type"), name.alias("field"))
    g = d.groupBy("app", "kind", "type").agg(F.max(F.col("field").isNull()).alias("whole"), F.array_sort(F.collect_set("field")).alias("fields"))
    return g.select("app", "kind", "type", F.when(~F.col("whole"), F.col("fields")).alias("fields"))


def relation_split(edges: DataFrame, grants: DataFrame, shared: bool = False) -> DataFrame:
    """edges (from_type, to_type, relation, ...) with allowed, by grants of the same three columns; shared: whatever from_type."""
    key = ["to_type", "relation"] if shared else ["from_type", "to_type", "relation"]
    return edges.join(grants.select(*key).distinct().withColumn("allowed", F.lit(True)), key, "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))
