"""Driver queries over entities, references, duplicates, access, quotas, projects and migrations."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import scalars as X
from loomgraph.operators import access, counters, dedup, lifecycle, migrate, projects, quota, tables, validation
from loomgraph.plans.base import DAY, NOW, PEOPLE, WORKSPACES, E, activity, people, sql, table, workspaces
from loomgraph.plans.checkpoints import ensure
from loomgraph.sources import export

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


def _now():  # noqa: ANN202
    return F.timestamp_micros(F.lit(NOW))


@query(sql(PEOPLE, select="SELECT id, name, deleted_us FROM P WHERE _deleted AND _owner = 'MACHINERY' ORDER BY deleted_us DESC, id LIMIT 25 OFFSET 5"))
def trash_view(spark, sf):  # noqa: ANN001, ANN201
    d = lifecycle.trash(people(spark, sf), "MACHINERY", "Person", 25, 5)
    return d.select("id", "name", F.unix_micros("_deleted_at").alias("deleted_us"))


@query(sql(PEOPLE, select="SELECT _owner AS type, count(*) AS n FROM P WHERE _deleted GROUP BY ROLLUP (_owner)"))
def trash_summary(spark, sf):  # noqa: ANN001, ANN201
    return lifecycle.trash_summary(people(spark, sf).withColumn("_type", F.col("_owner"))).select(F.col("_type").alias("type"), "n")


@query(sql(PEOPLE, select=f"SELECT id FROM P WHERE _deleted AND deleted_us < {NOW} - CASE _owner WHEN 'MACHINERY' THEN 60 WHEN 'BUILDING' THEN 10 ELSE 30 END * {DAY}"))
def expired_trash(spark, sf):  # noqa: ANN001, ANN201
    p = people(spark, sf).withColumn("_type", F.col("_owner"))
    days = p.select("_type").distinct().select("_type", F.when(F.col("_type") == "MACHINERY", 60).when(F.col("_type") == "BUILDING", 10).alias("days"))
    return lifecycle.expired_trash(p, days, _now()).select("id")


@query(sql(PEOPLE, select="SELECT id, _deleted, CASE WHEN _deleted THEN 'only' ELSE 'exclude' END AS mode FROM P"))
def deleted_filter(spark, sf):  # noqa: ANN001, ANN201
    p = people(spark, sf).select("id", "_deleted")
    return lifecycle.apply_deleted(p).withColumn("mode", F.lit("exclude")).unionByName(lifecycle.apply_deleted(p, "only").withColumn("mode", F.lit("only")))


@query(sql(PEOPLE, select=f"SELECT id, CASE WHEN _owner = 'FURNITURE' THEN NULL WHEN _owner = 'BUILDING' THEN TRUE ELSE _pending_delete END AS pending, CASE WHEN _owner = 'FURNITURE' THEN NULL WHEN _owner = 'BUILDING' THEN {NOW} ELSE pending_us END AS at FROM P"))
def uninstall_mark_unmark(spark, sf):  # noqa: ANN001, ANN201
    p = people(spark, sf)
    owner = lambda o: p.where(F.col("_owner") == o).select("_owner")
    d = lifecycle.unmark_pending(lifecycle.mark_pending(p, owner("BUILDING"), _now()), owner("FURNITURE"))
    return d.select("id", F.col("_pending_delete").alias("pending"), F.unix_micros("_pending_delete_at").alias("at"))


@query(sql(PEOPLE, select=f"SELECT id, _type AS type FROM P WHERE _pending_delete AND pending_us < {NOW - 14 * DAY}"))
def expired_pending(spark, sf):  # noqa: ANN001, ANN201
    return lifecycle.expired_pending(people(spark, sf), _now(), 14).select("id", F.col("_type").alias("type"))


@query("""WITH B AS (SELECT c_custkey AS id, 'seg.' || lower(c_mktsegment) || CASE WHEN c_custkey % 5 = 0 THEN '.Odd' ELSE '.Card' END AS _type, 'seg.' || lower(CASE WHEN c_custkey % 7 = 0 THEN 'OTHER' ELSE c_mktsegment END) AS app,
 CASE WHEN c_custkey % 11 <> 0 THEN c_name END AS title, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS score FROM customer)
 SELECT id, CASE WHEN c THEN 'scope' WHEN NOT starts_with(_type, app || '.') THEN 'namespace' WHEN _type LIKE '%.Odd' THEN 'type' WHEN title IS NULL THEN 'required' END AS reject, coalesce(score, 7) AS score,
 CASE WHEN NOT c AND starts_with(_type, app || '.') AND _type NOT LIKE '%.Odd' AND title IS NOT NULL THEN 1 END AS version FROM (SELECT *, app LIKE '%automobile' AS c FROM B)""")
def create_batch(spark, sf):  # noqa: ANN001, ANN201
    c = table(spark, sf, "customer")
    key = F.col("c_custkey")
    kind = F.concat(F.lit("seg."), F.lower("c_mktsegment"), F.when(key % 5 == 0, ".Odd").otherwise(".Card"))
    app = F.concat(F.lit("seg."), F.lower(F.when(key % 7 == 0, F.lit("OTHER")).otherwise(F.col("c_mktsegment"))))
    b = c.select(key.alias("id"), kind.alias("_type"), app.alias("app"), F.when(key % 11 != 0, F.col("c_name")).alias("title"), F.when(key % 3 == 0, F.col("c_nationkey")).alias("score"))
    scopes = b.select("app", "_type").distinct().where("app not like '%automobile'")
    known = b.select("_type").distinct().where("_type like '%.Card'")
    d = lifecycle.create(b, scopes, known, ["title"], {"score": 7}, _now())
    return d.select("id", "reject", "score", F.col("_version").cast("int").alias("version"))


CHANGED = """C AS (SELECT id, CASE WHEN id % 9 = 0 THEN 'OTHER' ELSE _owner END AS app, CASE WHEN id % 5 = 0 THEN 99 ELSE _version END AS expected_version, id % 2 AS ord, CASE WHEN id % 4 = 0 THEN name || '!' END AS name, CASE WHEN id % 6 = 0 THEN nation + 1 END AS nation FROM P WHERE id % 3 = 0
 UNION ALL SELECT id, _owner, _version, 5, 'late', NULL FROM P WHERE id % 15 = 3 UNION ALL SELECT id + 10000000, _owner, _version, 0, NULL, NULL FROM P WHERE id % 100 = 0)"""


@query(sql(PEOPLE, CHANGED, select="""SELECT C.id, C.ord, CASE WHEN P.id IS NULL THEN 'missing' WHEN P._owner <> C.app THEN 'owner' WHEN C.expected_version <> P._version OR n > 1 THEN 'version' WHEN C.nation IS NOT NULL AND C.nation <> P.nation THEN 'immutable' END AS reject,
 CASE WHEN P._owner = C.app AND C.expected_version = P._version AND n = 1 AND (C.nation IS NULL OR C.nation = P.nation) THEN coalesce(C.name, P.name) END AS name,
 CASE WHEN P._owner = C.app AND C.expected_version = P._version AND n = 1 AND (C.nation IS NULL OR C.nation = P.nation) THEN P._version + 1 END AS version
 FROM (SELECT *, row_number() OVER (PARTITION BY id, expected_version ORDER BY ord) AS n FROM C) C LEFT JOIN P ON C.id = P.id"""))  # fmt: skip
def update_batch(spark, sf):  # noqa: ANN001, ANN201
    p = people(spark, sf)
    i = F.col("id")
    a = p.where(i % 3 == 0).select("id", F.when(i % 9 == 0, "OTHER").otherwise(F.col("_owner")).alias("app"), F.when(i % 5 == 0, 99).otherwise(F.col("_version")).alias("expected_version"), (i % 2).alias("order"), F.when(i % 4 == 0, F.concat("name", F.lit("!"))).alias("name"), F.when(i % 6 == 0, F.col("nation") + 1).alias("nation"))
    b = p.where(i % 15 == 3).select("id", F.col("_owner").alias("app"), F.col("_version").alias("expected_version"), F.lit(5).cast("bigint").alias("order"), F.lit("late").alias("name"), F.lit(None).cast("int").alias("nation"))
    c = p.where(i % 100 == 0).select((i + 10000000).alias("id"), F.col("_owner").alias("app"), F.col("_version").alias("expected_version"), F.lit(0).cast("bigint").alias("order"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("nation"))
    d = lifecycle.update(p, a.unionByName(b).unionByName(c), ["nation"], ["name", "nation"], _now())
    return d.select("id", F.col("order").alias("ord"), "reject", "name", F.col("_version").alias("version"))


@query(sql(PEOPLE, select="""SELECT id, CASE WHEN id % 3 <> 0 THEN NULL WHEN id % 9 = 0 AND _owner <> 'OTHER' THEN 'owner' WHEN _deleted THEN 'deleted' END AS reject, _deleted OR (id % 3 = 0 AND id % 9 <> 0) AS deleted FROM P"""))
def soft_delete(spark, sf):  # noqa: ANN001, ANN201
    p = people(spark, sf)
    r = p.where("id % 3 = 0").select("id", F.when(F.col("id") % 9 == 0, "OTHER").otherwise(F.col("_owner")).alias("app"))
    return lifecycle.soft_delete(p, r, _now()).select("id", "reject", F.col("_deleted").alias("deleted"))


@query(sql(PEOPLE, select="""SELECT id, CASE WHEN id % 3 <> 0 THEN NULL WHEN NOT _deleted THEN 'not_deleted' WHEN id % 9 = 0 THEN 'owner' END AS reject, _deleted AND NOT (id % 3 = 0 AND id % 9 <> 0) AS deleted, _version + CASE WHEN _deleted AND id % 3 = 0 AND id % 9 <> 0 THEN 1 ELSE 0 END AS version FROM P"""))
def restore(spark, sf):  # noqa: ANN001, ANN201
    p = people(spark, sf)
    r = p.where("id % 3 = 0").select("id", F.when(F.col("id") % 9 == 0, "OTHER").otherwise(F.col("_owner")).alias("app"))
    return lifecycle.restore(p, r, _now()).select("id", "reject", F.col("_deleted").alias("deleted"), F.col("_version").alias("version"))


def _order_edges(spark, sf):  # noqa: ANN001, ANN202
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("src_id"), F.col("o_custkey").alias("dst_id"))


@query("SELECT o_orderkey AS src_id, 'PLACED_BY' AS relation, o_custkey AS dst_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0")
def orphan_refs(spark, sf):  # noqa: ANN001, ANN201
    return lifecycle.orphan_references(_order_edges(spark, sf), people(spark, sf), "PLACED_BY").select("src_id", "relation", "dst_id")


@query("SELECT l_orderkey AS id, l_linenumber AS line, field, target FROM (SELECT l_orderkey, l_linenumber, 'part' AS field, CAST(l_partkey AS VARCHAR) AS target FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'supplier', CAST(l_suppkey AS VARCHAR) FROM lineitem) WHERE target NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 3 <> 0)")
def dangling_refs(spark, sf):  # noqa: ANN001, ANN201
    lines = table(spark, sf, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("id"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"))
    d = lifecycle.dangling_references(lines, ["part", "supplier"], table(spark, sf, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id")))
    return d.select(F.col("id.l_orderkey").alias("id"), F.col("id.l_linenumber").alias("line"), "field", "target")


@query("SELECT DISTINCT c_mktsegment AS type FROM customer WHERE c_mktsegment NOT IN (SELECT c_mktsegment FROM customer WHERE c_mktsegment LIKE '%U%')")
def missing_schemas(spark, sf):  # noqa: ANN001, ANN201
    p = people(spark, sf).withColumn("_type", F.col("_owner"))
    return lifecycle.missing_schemas(p, p.where("_type like '%U%'").select("_type").distinct()).select(F.col("_type").alias("type"))


@query("""SELECT 'orphan' AS kind, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0
 UNION ALL SELECT 'dangling', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)
 UNION ALL SELECT 'missing_schema', count(*) FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment NOT LIKE '%U%')""")
def integrity_summary(spark, sf):  # noqa: ANN001, ANN201
    p, e = people(spark, sf), _order_edges(spark, sf)
    rows = e.select(F.col("src_id").alias("id"), F.col("dst_id").alias("customer"))
    typed = p.withColumn("_type", F.col("_owner"))
    return validation.integrity({
        "orphan": lifecycle.orphan_references(e, p, "PLACED_BY"),
        "dangling": lifecycle.dangling_references(rows, ["customer"], p.where("id % 10 <> 0")),
        "missing_schema": lifecycle.missing_schemas(typed, typed.where("_type like '%U%'").select("_type").distinct()),
    })


@query("""WITH C AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < -900), O AS (SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT id FROM C))
 SELECT '0' AS level, CAST(id AS VARCHAR) AS id FROM C UNION ALL SELECT 'orders', CAST(id AS VARCHAR) FROM O UNION ALL SELECT 'lines', l_orderkey || '-' || l_linenumber FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT id FROM O))""")
def cascade_delete(spark, sf):  # noqa: ANN001, ANN201
    start = table(spark, sf, "customer").where("c_acctbal < -900").select(F.col("c_custkey").alias("id"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("ref"))
    lines = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").alias("ref"))
    return lifecycle.cascade(start, [("orders", o), ("lines", lines)])


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0 AND c_custkey IN (SELECT o_custkey FROM orders)")
def restricted_delete(spark, sf):  # noqa: ANN001, ANN201
    return lifecycle.restricted(people(spark, sf).where("_deleted").select("id"), _order_edges(spark, sf).select(F.col("dst_id").alias("ref")))


@query("SELECT o_orderkey AS id, CASE WHEN c_acctbal >= 0 THEN o_custkey END AS customer FROM orders JOIN customer ON o_custkey = c_custkey")
def nullify_refs(spark, sf):  # noqa: ANN001, ANN201
    rows = _order_edges(spark, sf).select(F.col("src_id").alias("id"), F.col("dst_id").alias("customer"))
    return lifecycle.nullify(rows, "customer", people(spark, sf).where("_deleted"))


@query(sql(PEOPLE, select="""SELECT 'node' AS kind, id AS a, id AS b FROM P WHERE NOT _deleted UNION ALL SELECT DISTINCT 'edge', o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT id FROM P WHERE _deleted) AND o_orderkey NOT IN (SELECT id FROM P WHERE _deleted)"""))
def permanent_delete(spark, sf):  # noqa: ANN001, ANN201
    p = people(spark, sf)
    n, e = lifecycle.delete_for_good(p.select("id"), _order_edges(spark, sf), p.where("_deleted"))
    return n.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("id").alias("b")).unionByName(e.distinct().select(F.lit("edge").alias("kind"), F.col("src_id").alias("a"), F.col("dst_id").alias("b")))


IMPORT = """X AS (SELECT p_partkey AS id, p_name AS name, p_size AS size, 1 AS _version FROM part WHERE p_partkey % 3 <> 0), I AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 <> 0 THEN upper(p_name) END AS name, p_size + 1 AS size, 9 AS _version FROM part WHERE p_partkey % 2 = 0)"""


def _import(mode: str):  # noqa: ANN202
    both = {"skip": ("skipped", "X.name", "X.size", "X._version"), "replace": ("replaced", "I.name", "I.size", "I._version"), "merge": ("merged", "coalesce(I.name, X.name)", "coalesce(I.size, X.size)", "X._version")}[mode]
    pick = lambda c, v: f"CASE WHEN X.id IS NOT NULL AND I.id IS NOT NULL THEN {v} WHEN X.id IS NOT NULL THEN X.{c} ELSE I.{c} END AS {c.strip('_')}"
    oracle = sql(IMPORT, select=f"SELECT coalesce(X.id, I.id) AS id, CASE WHEN I.id IS NULL THEN 'kept' WHEN X.id IS NULL THEN 'inserted' ELSE '{both[0]}' END AS outcome, {pick('name', both[1])}, {pick('size', both[2])}, {pick('_version', both[3])} FROM X FULL JOIN I ON X.id = I.id")

    def run(spark, sf):  # noqa: ANN001, ANN202
        p, k = table(spark, sf, "part"), F.col("p_partkey")
        x = p.where(k % 3 != 0).select(k.alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.lit(1).alias("_version"))
        i = p.where(k % 2 == 0).select(k.alias("id"), F.when(k % 4 != 0, F.upper("p_name")).alias("name"), (F.col("p_size") + 1).alias("size"), F.lit(9).alias("_version"))
        return lifecycle.import_rows(x, i, mode).withColumnRenamed("_version", "version")

    run.__name__ = f"import_{mode}"
    return query(oracle)(run)


for _mode in ("skip", "replace", "merge"):
    _import(_mode)


@query(sql(IMPORT, select="SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN I.id IS NULL THEN 'kept' WHEN X.id IS NULL THEN 'inserted' ELSE 'merged' END AS outcome FROM X FULL JOIN I ON X.id = I.id) GROUP BY 1"))
def import_counts(spark, sf):  # noqa: ANN001, ANN201
    return lifecycle.outcome_counts(QUERIES["import_merge"](spark, sf))


# Names that lie close together: suppliers' and customers' numbers, shortened. Every 4th has no email, so that names decide.
CONTACTS = """T AS (SELECT id, email, name FROM (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 <> 0 THEN 'm' || (s_suppkey % 30) || '@x' END AS email, s_name || '-' || (s_nationkey % 5) AS name FROM supplier
 UNION ALL SELECT 1000000 + c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN 'm' || (c_custkey % 30) || '@x' END, 'Supplier#' || right(c_name, 9) || '-' || (c_nationkey % 5) FROM customer))"""
SET = "list_distinct(list_filter(string_split(lower({0}), ''), lambda z: z <> ''))"
JACCARD = f"CASE WHEN {{a}} = {{b}} THEN 1.0 WHEN lower({{a}}) = lower({{b}}) THEN 0.95 ELSE len(list_intersect({SET.format('{a}')}, {SET.format('{b}')})) / len(list_distinct(list_concat({SET.format('{a}')}, {SET.format('{b}')}))) END"
ALIKE = f"len(list_intersect({{a}}, {{b}})) >= 0.85 * (len({{a}}) + len({{b}}) - len(list_intersect({{a}}, {{b}})))"
# each two rows compared; connected rows meet from the rows that are smaller than all they link with
EVERY = f"""S AS (SELECT *, {SET.format("name")} AS c FROM T), EP AS (SELECT x.id AS a, y.id AS b FROM S x JOIN S y ON x.id <> y.id AND coalesce(x.email = y.email, TRUE) AND {ALIKE.format(a="x.c", b="y.c")}),
 LO AS (SELECT id FROM S WHERE id IN (SELECT a FROM EP) AND id NOT IN (SELECT a FROM EP WHERE b < a)), RE AS (SELECT id AS root, id FROM LO UNION SELECT RE.root, EP.b FROM RE JOIN EP ON RE.id = EP.a)"""
# the suggestions by class: members, classes of one email, and those that lack one with their hubs
PAIRS = f"""S AS (SELECT *, list_sort({SET.format("name")}) AS c FROM T), CL AS (SELECT email, c, min(id) AS first FROM S GROUP BY email, c), SE AS (SELECT c, min(first) AS rep, min(first) FILTER (WHERE email IS NULL) AS lacking FROM CL GROUP BY c),
 NE AS (SELECT x.c AS a, y.c AS b, x.lacking, y.rep FROM SE x JOIN SE y ON {ALIKE.format(a="x.c", b="y.c")}), HU AS (SELECT b, min(lacking) AS hub FROM NE GROUP BY b),
 PR AS (SELECT CL.first AS i, S.id AS j FROM S JOIN CL ON S.c = CL.c AND S.email IS NOT DISTINCT FROM CL.email UNION SELECT x.first, y.first FROM CL x JOIN CL y ON x.email = y.email AND {ALIKE.format(a="x.c", b="y.c")}
 UNION SELECT hub, first FROM HU JOIN CL ON HU.b = CL.c WHERE hub IS NOT NULL UNION SELECT lacking, rep FROM NE WHERE lacking IS NOT NULL),
 D AS (SELECT DISTINCT least(i, j) AS source_id, greatest(i, j) AS target_id FROM PR WHERE i <> j)"""


def _contacts(spark, sf):  # noqa: ANN001, ANN202
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    mail = lambda k: F.when(k % 4 != 0, F.concat(F.lit("m"), (k % 30).cast("string"), F.lit("@x"))).alias("email")
    a = s.select(F.col("s_suppkey").alias("id"), mail(F.col("s_suppkey")), F.concat("s_name", F.lit("-"), (F.col("s_nationkey") % 5).cast("string")).alias("name"))
    k = F.col("c_custkey")
    b = c.select((k + 1000000).alias("id"), mail(k), F.concat(F.lit("Supplier#"), F.right("c_name", F.lit(9)), F.lit("-"), (F.col("c_nationkey") % 5).cast("string")).alias("name"))
    return a.unionByName(b)


@query("WITH RECURSIVE " + CONTACTS + ", " + EVERY + " SELECT id, min(root) AS root FROM RE GROUP BY id")
def dup_candidates(spark, sf):  # noqa: ANN001, ANN201
    """Contacts that have a duplicate, with the smallest id that they are connected with."""
    ensure(spark)
    return dedup.connected(dedup.candidates(_contacts(spark, sf), "Person"))


@query(sql(CONTACTS, PAIRS, select=f"SELECT sha1(source_id || '|' || target_id) AS id, source_id, target_id, 'pending' AS status, {NOW} + source_id AS created_us FROM D ORDER BY created_us DESC, id LIMIT 40"))
def merge_suggestions(spark, sf):  # noqa: ANN001, ANN201
    d = dedup.suggestions(dedup.candidates(_contacts(spark, sf), "Person"), "Person", F.timestamp_micros(F.lit(NOW) + F.col("source_id")))
    return dedup.pending(d, 40, "Person").select("id", "source_id", "target_id", "status", F.unix_micros("created_at").alias("created_us"))


@query("""WITH RECURSIVE M AS (SELECT c_custkey AS d, c_custkey + 1 AS k FROM customer WHERE c_custkey % 4 IN (0, 1)), W AS (SELECT d, k FROM M UNION ALL SELECT W.d, M.k FROM W JOIN M ON W.k = M.d), L AS (SELECT d, max(k) AS k FROM W GROUP BY d)
 SELECT DISTINCT o_orderkey AS src_id, coalesce(L.k, o_custkey) AS dst_id FROM orders LEFT JOIN L ON o_custkey = L.d""")
def apply_merge(spark, sf):  # noqa: ANN001, ANN201
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    m = c.where("id % 4 in (0, 1)").select(F.col("id").alias("source_id"), (F.col("id") + 1).alias("target_id"))
    e = _order_edges(spark, sf).select(F.concat(F.lit("o"), "src_id").alias("src_id"), F.concat(F.lit("c"), "dst_id").alias("dst_id"))
    m = m.select(F.concat(F.lit("c"), F.col("source_id").cast("string")).alias("source_id"), F.concat(F.lit("c"), F.col("target_id").cast("string")).alias("target_id"))
    ensure(spark)
    d = dedup.apply_merges(c.select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("id")), e, m)[1]
    return d.select(F.expr("cast(substring(src_id, 2) as bigint)").alias("src_id"), F.expr("cast(substring(dst_id, 2) as bigint)").alias("dst_id"))


@query(f"SELECT c_custkey AS id, n_nationkey AS nation, round({JACCARD.format(a='c_name', b='n_name')}, 6) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey")
def similarity_scalar(spark, sf):  # noqa: ANN001, ANN201
    d = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return d.select(F.col("c_custkey").alias("id"), F.col("n_nationkey").alias("nation"), F.round(X.string_similarity(F.col("c_name"), F.col("n_name")), 6).alias("s"))


@query(r"SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS name FROM documents")
def normalize_name(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "documents").select("doc_id", X.normalize_name(F.col("text")).alias("name"))


@query(r"""SELECT p_partkey AS id, list_transform(string_split(' ' || p_name || ' , ' || p_type, ','), lambda x: trim(x)) AS commas, string_split(p_name || chr(10) || p_type, chr(10)) AS lines, p_name || ', ' || p_type AS joined, lower(p_brand) AS low, upper(p_name) AS up, trim('  ' || p_name || ' ') AS trimmed, CAST(p_size AS VARCHAR) AS text FROM part""")
def transforms_strings(spark, sf):  # noqa: ANN001, ANN201
    p = table(spark, sf, "part")
    t, c = X.apply_transform, F.col
    return p.select(
        c("p_partkey").alias("id"), t("split_comma", F.concat(F.lit(" "), "p_name", F.lit(" , "), "p_type")).alias("commas"), t("split_newline", F.concat("p_name", F.lit("\n"), "p_type", F.lit("\r\n"))).alias("lines"),
        t("join_comma", F.array("p_name", "p_type")).alias("joined"), t("to_lowercase", c("p_brand")).alias("low"), t("to_uppercase", c("p_name")).alias("up"),
        t("trim", F.concat(F.lit("  "), "p_name", F.lit("\t"))).alias("trimmed"), t("to_string", c("p_size")).alias("text"),
    )


@query(r"""SELECT p_partkey AS id, CAST(regexp_extract(p_brand, '(\d+)', 1) AS BIGINT) AS i, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE CASE WHEN p_partkey % 3 = 1 THEN p_partkey END END AS j, p_retailprice AS f, CASE WHEN p_partkey % 2 = 0 THEN 0.0 END AS g FROM part""")
def transforms_numbers(spark, sf):  # noqa: ANN001, ANN201
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    t = X.apply_transform
    j = F.when(k % 3 == 0, None).when(k % 3 == 1, F.concat(F.lit(" +"), k.cast("string"))).otherwise(F.concat(k.cast("string"), F.lit(".5")))
    g = F.when(k % 2 == 0, F.lit(None).cast("string")).otherwise("1.0d")
    return p.select(k.alias("id"), t("parse_int", F.regexp_extract("p_brand", r"(\d+)", 1)).alias("i"), t("parse_int", j).alias("j"), t("parse_float", F.concat(F.lit(" "), F.col("p_retailprice").cast("string"))).alias("f"), t("parse_float", g).alias("g"))


@query(r"""SELECT event_id AS id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS text, CAST(floor(epoch(ts)) AS BIGINT) AS secs FROM events""")
def transforms_time(spark, sf):  # noqa: ANN001, ANN201
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    d = table(spark, sf, "events").select(F.col("event_id").alias("id"), X.apply_transform("epoch_to_datetime", s).alias("text"))
    return d.withColumn("secs", X.apply_transform("datetime_to_epoch", F.regexp_replace("text", "00:00$", "00:00")))


OPS = [
    {"op": "add_field", "field": "kind", "type": "string", "populate_from": "p_type"},
    {"op": "add_field", "field": "stock", "type": "int", "default": 3},
    {"op": "rename_field", "from": "p_name", "to": "title"},
    {"op": "change_type", "field": "p_brand", "type": "string[]", "transform": "split_comma"},
    {"op": "change_type", "field": "p_size", "type": "float"},
    {"op": "remove_field", "field": "p_type"},
    {"op": "add_index", "field": "title"},
    {"op": "rename_entity", "from": "Part", "to": "Item"},
    {"op": "custom", "query": "SELECT id, _type, title, kind, stock, p_brand, p_size FROM {entity}"},
]


@query("SELECT p_partkey AS id, 'Item' AS type, p_name AS title, p_type AS kind, CAST(3 AS BIGINT) AS stock, [p_brand] AS p_brand, CAST(p_size AS DOUBLE) AS p_size FROM part")
def migrate_entity(spark, sf):  # noqa: ANN001, ANN201
    p = table(spark, sf, "part").withColumn("id", F.col("p_partkey")).withColumn("_type", F.lit("Part"))
    return migrate.migrate(p, OPS).withColumnRenamed("_type", "type")


@query("SELECT p_partkey AS id, 'p_type' AS field FROM part")
def migration_rejects(spark, sf):  # noqa: ANN001, ANN201
    p = table(spark, sf, "part").withColumn("id", F.col("p_partkey"))
    return migrate.rejected(p, [{"op": "change_type", "field": "p_size", "type": "string", "transform": "to_string"}, {"op": "change_type", "field": "p_type", "type": "int", "transform": "parse_int"}])


@query("""WITH RECURSIVE S AS (SELECT DISTINCT p_partkey AS a, p_partkey + CASE WHEN p_partkey % 5 = 0 THEN 5 ELSE 1 END AS b FROM part)
, W AS (SELECT 1 AS at_, [1] AS way UNION ALL SELECT b, list_append(way, b) FROM W JOIN S ON at_ = a WHERE b <= 40), T AS (SELECT way FROM W WHERE at_ = 40 ORDER BY len(way), way LIMIT 1)
 SELECT i AS n, 'v' || way[i] AS from_version, 'v' || way[i + 1] AS to_version FROM (SELECT way, unnest(generate_series(1, len(way) - 1)) AS i FROM T)""")
def migration_chain(spark, sf):  # noqa: ANN001, ANN201
    ensure(spark)
    n = F.col("p_partkey")
    v = lambda c: F.concat(F.lit("v"), c.cast("string"))
    steps = table(spark, sf, "part").select(v(n).alias("from_version"), v(n + F.when(n % 5 == 0, 5).otherwise(1)).alias("to_version")).distinct()
    return migrate.chain(steps, "v1", "v40").select(F.col("n").cast("bigint").alias("n"), "from_version", "to_version")


GRANTS = "Q AS (SELECT DISTINCT 'app' || n_regionkey AS app, CASE WHEN n_nationkey % 3 = 0 THEN 'org.n' || n_nationkey || '.*' ELSE 'org.n' || n_nationkey || '.Card' END AS pattern, CASE WHEN n_nationkey % 2 = 0 THEN 'all' ELSE 'own' END AS scope FROM nation)"


def _grants(spark, sf):  # noqa: ANN001, ANN202
    n = table(spark, sf, "nation")
    k = F.col("n_nationkey")
    name = F.concat(F.lit("org.n"), k.cast("string"), F.when(k % 3 == 0, ".*").otherwise(".Card"))
    return n.select(F.concat(F.lit("app"), F.col("n_regionkey").cast("string")).alias("app"), name.alias("pattern"), F.when(k % 2 == 0, "all").otherwise("own").alias("scope")).distinct()


def _typed(spark, sf):  # noqa: ANN001, ANN202
    k = F.col("c_custkey")
    kind = F.concat(F.lit("org.n"), F.col("c_nationkey").cast("string"), F.when(k % 2 == 0, ".Card").otherwise(".sub.Deck"))
    return table(spark, sf, "customer").select(k.alias("id"), kind.alias("_type"), F.concat(F.lit("app"), (k % 5).cast("string")).alias("_owner"))


TYPED = "Y AS (SELECT c_custkey AS id, 'org.n' || c_nationkey || CASE WHEN c_custkey % 2 = 0 THEN '.Card' ELSE '.sub.Deck' END AS _type, 'app' || (c_custkey % 5) AS _owner FROM customer)"


@query(sql(GRANTS, TYPED, select="""SELECT id, _type AS type FROM Y WHERE EXISTS (SELECT 1 FROM Q WHERE app = 'app1' AND (Y._type = pattern OR (pattern LIKE '%.*' AND starts_with(Y._type, left(pattern, length(pattern) - 1)))) AND (scope = 'all' OR Y._owner = 'app1'))"""))
def access_scope_filter(spark, sf):  # noqa: ANN001, ANN201
    return access.readable(_typed(spark, sf), _grants(spark, sf), "app1").select("id", F.col("_type").alias("type"))


@query(sql(GRANTS, TYPED, select="SELECT DISTINCT app, _type AS type FROM Y JOIN Q ON Y._type = pattern OR (pattern LIKE '%.*' AND starts_with(Y._type, left(pattern, length(pattern) - 1)))"))
def allowed_types(spark, sf):  # noqa: ANN001, ANN201
    return access.allowed_types(_typed(spark, sf), _grants(spark, sf)).select("app", F.col("_type").alias("type"))


@query("SELECT c_custkey AS id, c_name AS name, CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN c_name || '@x' END AS email, CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN CAST(c_custkey AS VARCHAR) END AS phone FROM customer")
def masked_person(spark, sf):  # noqa: ANN001, ANN201
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat("c_name", F.lit("@x")).alias("email"), F.col("c_custkey").cast("string").alias("phone"), "c_mktsegment")
    return access.mask(c, "Person", access.first_party(F.col("c_mktsegment"), ["MACHINERY"], "BUILD")).drop("c_mktsegment")


@query("""WITH V AS (SELECT c_custkey AS id, 'app' || c_custkey % 50 AS viewer, c_custkey % 50 AS a FROM customer), S AS (SELECT *, a % 4 = 0 AS named, a % 6 = 0 AS wide, a % 5 = 0 AS own, a % 3 = 0 AS less FROM V)
 SELECT id, strict, own OR wide OR named AND NOT (strict AND less) AS email, own OR wide OR named AS phone FROM S, (SELECT unnest([FALSE, TRUE]) AS strict)""")
def masked_by_grants(spark, sf):  # noqa: ANN001, ANN201
    """Which viewers see people's email and phone: first parties and those with a grant for the type, in the strict form but for fields it excludes."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(k.alias("id"), F.concat(F.lit("app"), (k % 50).cast("string")).alias("viewer"), F.lit("e").alias("email"), F.lit("p").alias("phone"), (k % 50).alias("a"))
    a = c.select("viewer", "a").distinct()
    named = a.where("a % 4 = 0").select(F.col("viewer").alias("app"), F.lit("shared.Person").alias("pattern"), F.when(F.col("a") % 3 == 0, F.array(F.lit("email"))).alias("exclude"))
    wide = a.where("a % 6 = 0").select(F.col("viewer").alias("app"), F.lit("shared.*").alias("pattern"), F.lit(None).cast("array<string>").alias("exclude"))
    odd = a.select(F.col("viewer").alias("app"), F.lit("shared.Tag").alias("pattern"), F.lit(None).cast("array<string>").alias("exclude"))
    grants = named.unionByName(wide).unionByName(odd)
    parts = [access.mask_by_grants(c, "Person", "viewer", grants, F.col("a") % 5 == 0, strict).select("id", F.lit(strict).alias("strict"), F.col("email").isNotNull().alias("email"), F.col("phone").isNotNull().alias("phone")) for strict in (False, True)]
    return parts[0].unionByName(parts[1])


@query("""WITH G AS (SELECT 'app' || c_custkey % 200 AS app, 'read' AS kind, CASE c_custkey % 4 WHEN 3 THEN 'com.anki.*' ELSE 'system.N' || c_nationkey END AS type, CASE c_custkey % 4 WHEN 1 THEN 'path' WHEN 2 THEN 'name' END AS field FROM customer)
 SELECT app, kind, type, CASE WHEN bool_or(field IS NULL) THEN NULL ELSE list_sort(list_distinct(list(field) FILTER (WHERE field IS NOT NULL))) END AS fields FROM G GROUP BY 1, 2, 3""")
def grants_normalised(spark, sf):  # noqa: ANN001, ANN201
    k = F.col("c_custkey") % 4
    entry = F.when(k == 3, "com.anki.*").otherwise(F.concat(F.lit("system.N"), F.col("c_nationkey").cast("string"), F.when(k == 1, ".path").when(k == 2, ".name").otherwise("")))
    return access.normalise_grants(table(spark, sf, "customer").select(F.concat(F.lit("app"), (F.col("c_custkey") % 200).cast("string")).alias("app"), F.lit("read").alias("kind"), entry.alias("entry")))


@query("SELECT o_orderkey AS id, o_orderstatus = 'F' AND o_orderpriority LIKE '1%' AS allowed FROM orders")
def relation_permissions(spark, sf):  # noqa: ANN001, ANN201
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("Order").alias("from_type"), F.col("o_orderstatus").alias("to_type"), F.col("o_orderpriority").alias("relation"))
    g = o.where("to_type = 'F' and relation like '1%'").select("from_type", "to_type", "relation").distinct()
    return access.relation_split(o, g).select("id", "allowed")


USAGE = """Z AS (SELECT o_custkey % 50 AS app, o_orderkey AS ord, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END AS d, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END * CAST(floor(o_totalprice) AS BIGINT) AS b FROM orders),
 V AS (SELECT *, sum(d) OVER w AS s, sum(b) OVER w AS t FROM Z WINDOW w AS (PARTITION BY app ORDER BY ord)), U AS (SELECT app, arg_max(s, ord) - least(min(s), 0) AS entities, arg_max(t, ord) - least(min(t), 0) AS bytes FROM V GROUP BY app)"""


def _usage(spark, sf):  # noqa: ANN001, ANN202
    o = table(spark, sf, "orders")
    sign = F.when(F.col("o_orderstatus") == "F", -1).otherwise(1).cast("bigint")
    return quota.usage(o.select((F.col("o_custkey") % 50).alias("app"), F.col("o_orderkey").alias("order"), sign.alias("delta"), (sign * F.floor("o_totalprice")).alias("bytes")))


@query(sql(USAGE, select="SELECT app, CAST(entities AS BIGINT) AS entities, CAST(bytes AS BIGINT) AS bytes FROM U"))
def quota_usage(spark, sf):  # noqa: ANN001, ANN201
    return _usage(spark, sf)


@query("WITH RECURSIVE " + USAGE + """, A2 AS (SELECT o_custkey % 50 AS app, o_orderkey AS ord, CAST(floor(o_totalprice) AS BIGINT) AS b, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS i FROM orders),
 M AS (SELECT app, CAST(entities AS BIGINT) + 60 AS max_n, CAST(bytes AS BIGINT) + 9000000 AS max_b FROM U),
 B2 AS (SELECT A2.app, ord, i, CASE WHEN U.entities + 1 > max_n THEN 'entities' WHEN U.bytes + b > max_b THEN 'storage' END AS reject, CAST(U.entities + CASE WHEN U.entities + 1 > max_n OR U.bytes + b > max_b THEN 0 ELSE 1 END AS BIGINT) AS n, CAST(U.bytes + CASE WHEN U.entities + 1 > max_n OR U.bytes + b > max_b THEN 0 ELSE b END AS BIGINT) AS t FROM A2 JOIN U USING (app) JOIN M USING (app) WHERE i = 1
 UNION ALL SELECT A2.app, A2.ord, A2.i, CASE WHEN n + 1 > max_n THEN 'entities' WHEN t + b > max_b THEN 'storage' END, CAST(n + CASE WHEN n + 1 > max_n OR t + b > max_b THEN 0 ELSE 1 END AS BIGINT), CAST(t + CASE WHEN n + 1 > max_n OR t + b > max_b THEN 0 ELSE b END AS BIGINT) FROM B2 JOIN A2 ON A2.app = B2.app AND A2.i = B2.i + 1 JOIN M ON M.app = A2.app)
 SELECT app, ord, reject FROM B2""")
def quota_reject(spark, sf):  # noqa: ANN001, ANN201
    r = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("app"), F.col("o_orderkey").alias("order"), F.floor("o_totalprice").alias("bytes"))
    used = _usage(spark, sf)
    limits = used.select("app", (F.col("entities") + 60).alias("max_entities"), (F.col("bytes") + 9_000_000).alias("max_bytes"))
    return quota.check_requests(r, used, limits).select("app", F.col("order").alias("ord"), "reject")


APPS = """AP AS (SELECT DISTINCT CASE WHEN c_mktsegment = 'MACHINERY' THEN 'system' || CASE WHEN c_nationkey = 1 THEN '' ELSE '.n' || c_nationkey END WHEN c_mktsegment = 'HOUSEHOLD' THEN 'systems.n' || c_nationkey ELSE 'app.' || lower(c_mktsegment) || '.' || c_nationkey END AS app, c_nationkey AS nation FROM customer)"""


@query(sql(APPS, "TI AS (SELECT app, nation, CASE WHEN app = 'system' OR starts_with(app, 'system.') THEN 'system' WHEN app = 'app.furniture.3' OR starts_with(app, 'app.building.') THEN 'first_party' ELSE 'third_party' END AS tier FROM AP)",
           select="""SELECT app, tier, CASE WHEN nation = 7 THEN 5 WHEN tier = 'first_party' THEN 500000 WHEN tier = 'third_party' THEN 100000 END AS max_entities, CASE WHEN nation = 7 THEN NULL WHEN tier = 'first_party' THEN 2147483648 WHEN tier = 'third_party' THEN 524288000 END AS max_bytes,
 CASE WHEN nation = 7 THEN NULL WHEN tier = 'system' THEN 100000 WHEN tier = 'first_party' THEN 50000 ELSE 10000 END AS max_rows, CASE WHEN nation = 7 THEN NULL WHEN tier = 'first_party' THEN 1000 WHEN tier = 'third_party' THEN 100 END AS query_rate, CASE WHEN nation = 7 THEN 9 WHEN tier = 'first_party' THEN 500 WHEN tier = 'third_party' THEN 50 END AS write_rate FROM TI"""))  # fmt: skip
def tier_assign(spark, sf):  # noqa: ANN001, ANN201
    n, seg = F.col("c_nationkey"), F.col("c_mktsegment")
    app = F.when(seg == "MACHINERY", F.when(n == 1, "system").otherwise(F.concat(F.lit("system.n"), n.cast("string")))).when(seg == "HOUSEHOLD", F.concat(F.lit("systems.n"), n.cast("string"))).otherwise(F.concat_ws(".", F.lit("app"), F.lower(seg), n.cast("string")))
    a = table(spark, sf, "customer").select(app.alias("app"), n.alias("nation")).distinct()
    over = a.where("nation = 7").select("app", F.lit(5).alias("max_entities"), F.lit(9).alias("write_rate"))
    return quota.assign_tiers(a.drop("nation"), over, ["app.furniture.3"], "app.building.").select("app", "tier", *quota.LIMITS)


@query("""WITH RECURSIVE Q AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) // 20000 AS tick, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 20000, event_id) AS n FROM events),
 B AS (SELECT key, id, tick, n, TRUE AS admitted, 0.001::DOUBLE * 3000 - 1 AS tokens FROM Q WHERE n = 1
 UNION ALL SELECT Q.key, Q.id, Q.tick, Q.n, least(3.0, B.tokens + (Q.tick - B.tick) / 1e6::DOUBLE * 1.5) >= 1, least(3.0, B.tokens + (Q.tick - B.tick) / 1e6::DOUBLE * 1.5) - CASE WHEN least(3.0, B.tokens + (Q.tick - B.tick) / 1e6::DOUBLE * 1.5) >= 1 THEN 1 ELSE 0 END FROM B JOIN Q ON Q.key = B.key AND Q.n = B.n + 1)
 SELECT key, id, admitted FROM B""")
def rate_admission(spark, sf):  # noqa: ANN001, ANN201
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.expr("unix_micros(cast(ts as timestamp)) div 20000").alias("at"))
    return quota.admit(e, F.lit(1.5))


#: What a listing holds for each k: file name, whether it is a directory, its content (null: none), signal, confidence, name (null: the directory's, '-': no name, so no signal).
SIGNS = [
    (".project", False, '[project]\nname = "Work"', "explicit", 100, "Work"), (".project", False, '[project]\nname = "x"\n[tracker]\nprovider = "github"\nurl = "u"', "explicit", 100, None), (".project", False, '[project]\nname = "T"\n[tracker]\nprovider = "github-issues"\nurl = "u"', "explicit", 100, "T"),
    (".git", True, None, "git", 90, None), (".git", False, "gitdir: /elsewhere", "git", 90, None), (".git", True, '[remote "origin"]\n url = https://host/team/tool.git', "git", 90, "tool"),
    ("Cargo.toml", False, '[package]\nname = "crate"', "cargo", 80, "crate"), ("Cargo.toml", False, "[workspace]", "cargo", 80, "-"), ("package.json", False, '{"name": "pkg"}', "npm", 80, "pkg"), ("package.json", False, '{"name": ""}', "npm", 80, "-"),
    ("pyproject.toml", False, '[tool.poetry]\nname = "poem"', "python", 80, "poem"), ("go.mod", False, "module host/a/mod\n\ngo 1.2", "go", 80, "mod"), ("go.mod", False, "// first\nmodule host/a/mod", "go", 80, "-"), ("Big.sln", False, None, "dotnet", 80, "Big"),
    ("pom.xml", False, "<project>\n<artifactId> art </artifactId></project>", "maven", 80, "art"), ("build.gradle.kts", False, None, "gradle", 70, None), (".idea", True, None, "idea", 70, None), (".idea", False, None, None, 0, None), (".vscode", True, None, "vscode", 60, None),
    ("Makefile", False, None, "make", 50, None), ("makefile", False, None, "make", 50, None), ("README", False, None, None, 0, None),
]
#: Directories below a root in which the signs stand; hidden and junk ones and too deep ones hold no projects.
PLACES = ["", "/sub", "/vendor", "/venv", "/sub/deep/er/more", "/.hidden", "/node_modules/x", "/target", "/__pycache__", "/.cache", "/a/b"]
_text = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
LISTED = "SG(i, signal, confidence, nm) AS (VALUES " + ", ".join(f"({i}, {_text(x[3])}, {x[4]}, {_text(x[5])})" for i, x in enumerate(SIGNS)) + "), PL(j, place) AS (VALUES " + ", ".join(f"({j}, '{x}')" for j, x in enumerate(PLACES)) + f"""),
 LS AS (SELECT '/w/' || (p_partkey // 12) || place AS dir, i, signal, confidence, nm FROM part JOIN SG ON (p_partkey * 7 + p_partkey // 66) % {len(SIGNS)} = i JOIN PL ON p_partkey // 3 % {len(PLACES)} = j WHERE p_partkey > 0 AND (p_partkey % 9 < 3 OR p_partkey % 3 = 0))"""


def _listing(spark, sf):  # noqa: ANN001, ANN202
    """Twelve parts make a workspace, three of them a place in it; their signs differ in kind, and two places of three hold but one."""
    k = F.col("p_partkey")
    sign = F.get(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(dir_).alias("is_dir"), F.lit(c).cast("string").alias("content")) for n, dir_, c, *_ in SIGNS]), F.expr(f"cast((p_partkey * 7 + p_partkey div 66) % {len(SIGNS)} as int)"))
    place = F.get(F.array(*[F.lit(x) for x in PLACES]), F.expr(f"cast(p_partkey div 3 % {len(PLACES)} as int)"))
    d = table(spark, sf, "part").where((k > 0) & ((k % 9 < 3) | (k % 3 == 0))).select(F.concat(F.lit("/w/"), F.expr("cast(p_partkey div 12 as string)"), place).alias("dir"), sign.alias("s"))
    return d.select(F.concat_ws("/", "dir", "s.name").alias("path"), "s.is_dir", "s.content")


DETECT = """O1 AS (SELECT dir, signal, confidence, coalesce(nm, regexp_extract(dir, '([^/]+)$', 1)) AS name, i FROM LS WHERE signal IS NOT NULL AND coalesce(nm, '') <> '-' AND len(string_split(dir, '/')) - 1 <= 3 AND NOT regexp_matches(dir, '/(\\.[^/]*|vendor|node_modules|target|__pycache__)(/|$)')),
 T AS (SELECT dir AS root_path, arg_min(signal, i) AS signal, arg_min(confidence, i) AS confidence, arg_min(name, i) AS name FROM O1 GROUP BY dir)"""
OUTER = "SELECT * FROM T WHERE NOT EXISTS (SELECT 1 FROM T u WHERE starts_with(T.root_path, u.root_path || '/'))"


@query(sql(LISTED, DETECT, select=OUTER))
def detect_projects(spark, sf):  # noqa: ANN001, ANN201
    return projects.detect(_listing(spark, sf), max_depth=3)


@query(sql(WORKSPACES, "D AS (SELECT root_path || CASE WHEN k % 2 = 0 THEN '' ELSE '/x' END AS root_path FROM R UNION SELECT root_path || '/x/y' FROM R)", select="SELECT root_path FROM D WHERE NOT EXISTS (SELECT 1 FROM D u WHERE starts_with(D.root_path, u.root_path || '/'))"))
def nested_roots_dropped(spark, sf):  # noqa: ANN001, ANN201
    r = workspaces(spark, sf)
    d = r.select(F.concat("root_path", F.when(F.col("k") % 2 == 0, "").otherwise("/x")).alias("root_path")).unionByName(r.select(F.concat("root_path", F.lit("/x/y")).alias("root_path"))).distinct()
    return projects.outermost(d)


@query(sql(LISTED, DETECT, f"FD AS ({OUTER})", "ST AS (SELECT DISTINCT '/w/' || g AS root_path, 'old' || g AS name, g % 3 = 0 AS inferred, g % 3 <> 0 AS promoted, 60 AS confidence, CASE WHEN g % 7 = 0 THEN 'archived' ELSE 'active' END AS status FROM (SELECT p_partkey // 12 AS g FROM part) WHERE g % 20 < 12)",
           """TR AS (SELECT coalesce(s.root_path, f.root_path) AS root_path, CASE WHEN s.root_path IS NULL THEN 'insert' WHEN f.root_path IS NULL THEN CASE WHEN s.status = 'archived' OR s.inferred THEN 'keep' ELSE 'archive' END WHEN f.signal = 'explicit' THEN 'update' WHEN NOT s.inferred THEN 'demote' ELSE 'keep' END AS transition,
 s.name AS sn, f.name AS fn, s.inferred AS si, s.promoted AS sp, f.signal = 'explicit' AS ex, s.confidence AS sc, f.confidence AS fc, s.status AS ss FROM ST s FULL JOIN FD f ON s.root_path = f.root_path)""",
           select="""SELECT root_path, transition, CASE WHEN transition IN ('insert', 'update') THEN fn ELSE sn END AS name, CASE WHEN transition IN ('insert', 'update') THEN NOT ex WHEN transition = 'demote' THEN TRUE ELSE si END AS inferred,
 CASE WHEN transition IN ('insert', 'update') THEN ex OR coalesce(sp, FALSE) WHEN transition = 'demote' THEN FALSE ELSE sp END AS promoted, CASE WHEN transition IN ('insert', 'update', 'demote') THEN fc ELSE sc END AS confidence, CASE WHEN transition = 'archive' THEN 'archived' WHEN transition IN ('insert', 'update') THEN 'active' ELSE ss END AS status FROM TR"""))  # fmt: skip
def reconcile_projects(spark, sf):  # noqa: ANN001, ANN201
    g = F.col("g")
    st = table(spark, sf, "part").select(F.expr("p_partkey div 12").alias("g")).distinct().where(g % 20 < 12).select(
        F.concat(F.lit("/w/"), g.cast("string")).alias("root_path"), F.concat(F.lit("old"), g.cast("string")).alias("name"), (g % 3 == 0).alias("inferred"), (g % 3 != 0).alias("promoted"),
        F.lit(60).alias("confidence"), F.when(g % 7 == 0, "archived").otherwise("active").alias("status"),
    )
    return projects.reconcile(st, projects.detect(_listing(spark, sf), max_depth=3))


@query(sql(WORKSPACES, select="SELECT project_id AS id, CASE WHEN k % 3 <> 0 THEN 'alive' WHEN inferred THEN 'deleted' ELSE 'archived' END AS outcome FROM R"))
def prune_projects(spark, sf):  # noqa: ANN001, ANN201
    r = workspaces(spark, sf)
    return projects.prune(r, r.where("k % 3 <> 0").select(F.col("root_path").alias("path"))).select(F.col("project_id").alias("id"), "outcome")


@query(sql(WORKSPACES, select="SELECT o AS outcome, count(id) AS n FROM (SELECT unnest(['alive', 'archived', 'deleted']) AS o) LEFT JOIN (SELECT project_id AS id, CASE WHEN k % 3 <> 0 THEN 'alive' WHEN inferred THEN 'deleted' ELSE 'archived' END AS outcome FROM R) ON o = outcome GROUP BY 1"))
def prune_counters(spark, sf):  # noqa: ANN001, ANN201
    """Counters of a pruning pass, observed while its rows are written."""
    r = workspaces(spark, sf)
    d = projects.prune(r, r.where("k % 3 <> 0").select(F.col("root_path").alias("path")))
    return counters.as_rows(spark, counters.write_counted(d, f"{ensure(spark)}/pruned-{uuid.uuid4().hex}", ["alive", "archived", "deleted"]))


@query("SELECT outcome, n FROM (SELECT 'migrated' AS outcome, count(*) FILTER (WHERE p_partkey % 7 <> 0) AS n FROM part UNION ALL SELECT 'rejected', count(*) FILTER (WHERE p_partkey % 7 = 0) FROM part)")
def migration_counters(spark, sf):  # noqa: ANN001, ANN201
    """Counters of a migration that can't convert every seventh size, observed while its rows are written."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 7 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("size"), F.lit("Part").alias("_type"))
    ops = [{"op": "change_type", "field": "size", "type": "int", "transform": "parse_int"}]
    bad = migrate.rejected(p, ops).select("id").distinct().withColumn("bad", F.lit(True))
    d = migrate.migrate(p, ops).join(bad, "id", "left").withColumn("outcome", F.when(F.col("bad"), "rejected").otherwise("migrated")).drop("bad")
    return counters.as_rows(spark, counters.write_counted(d, f"{ensure(spark)}/migrated-{uuid.uuid4().hex}", ["migrated", "rejected"]))


# customers, parts and orders refer to one another in a circle, customers to themselves
_REFS = """RF AS (SELECT 'order' AS kind, o_orderkey AS id, 'customer' AS field, 'customer' AS ref_kind, o_custkey AS ref_id, 'cascade' AS policy FROM orders
 UNION ALL SELECT 'part', p_partkey, 'order', 'order', p_partkey * 4 + 1, 'cascade' FROM part UNION ALL SELECT 'customer', c_custkey, 'part', 'part', c_custkey * 3, 'cascade' FROM customer
 UNION ALL SELECT 'customer', c_custkey, 'parent', 'customer', c_custkey - 50, 'cascade' FROM customer WHERE c_custkey % 3 = 0
 UNION ALL SELECT 'supplier', s_suppkey, 'customer', 'customer', s_suppkey * 20, 'restrict' FROM supplier UNION ALL SELECT 'part', p_partkey, 'order', 'order', p_partkey * 7, 'restrict' FROM part WHERE p_partkey % 30 = 0
 UNION ALL SELECT 'lineitem', l_orderkey * 10 + l_linenumber, 'order', 'order', l_orderkey, 'nullify' FROM lineitem)"""


def _references(spark, sf):  # noqa: ANN001, ANN202
    t = {n: table(spark, sf, n) for n in ("orders", "part", "customer", "supplier", "lineitem")}
    ref = lambda d, kind, i, field, to, at, policy: d.select(F.lit(kind).alias("kind"), F.expr(i).cast("long").alias("id"), F.lit(field).alias("field"), F.lit(to).alias("ref_kind"), F.expr(at).cast("long").alias("ref_id"), F.lit(policy).alias("policy"))
    return reduce(DataFrame.unionByName, [
        ref(t["orders"], "order", "o_orderkey", "customer", "customer", "o_custkey", "cascade"), ref(t["part"], "part", "p_partkey", "order", "order", "p_partkey * 4 + 1", "cascade"),
        ref(t["customer"], "customer", "c_custkey", "part", "part", "c_custkey * 3", "cascade"), ref(t["customer"].where("c_custkey % 3 = 0"), "customer", "c_custkey", "parent", "customer", "c_custkey - 50", "cascade"),
        ref(t["supplier"], "supplier", "s_suppkey", "customer", "customer", "s_suppkey * 20", "restrict"), ref(t["part"].where("p_partkey % 30 = 0"), "part", "p_partkey", "order", "order", "p_partkey * 7", "restrict"),
        ref(t["lineitem"], "lineitem", "l_orderkey * 10 + l_linenumber", "order", "order", "l_orderkey", "nullify"),
    ])


@query(f"""WITH RECURSIVE {_REFS}, ST AS (SELECT 'customer' AS kind, c_custkey AS id FROM customer WHERE c_custkey % 10 = 0),
 RC AS (SELECT kind AS sk, id AS si, kind, id FROM ST UNION SELECT RC.sk, RC.si, f.kind, f.id FROM RC JOIN RF f ON f.policy = 'cascade' AND f.ref_kind = RC.kind AND f.ref_id = RC.id),
 HE AS (SELECT DISTINCT RC.sk, RC.si FROM RC JOIN RF f ON f.policy = 'restrict' AND f.ref_kind = RC.kind AND f.ref_id = RC.id WHERE NOT EXISTS (SELECT 1 FROM RC o WHERE o.sk = RC.sk AND o.si = RC.si AND o.kind = f.kind AND o.id = f.id)),
 GO AS (SELECT DISTINCT kind, id FROM RC WHERE NOT EXISTS (SELECT 1 FROM HE WHERE HE.sk = RC.sk AND HE.si = RC.si))
 SELECT kind, id, 'start' AS field, CASE WHEN EXISTS (SELECT 1 FROM HE WHERE HE.sk = ST.kind AND HE.si = ST.id) THEN 'restricted' ELSE 'deleted' END AS effect FROM ST
 UNION ALL SELECT kind, id, NULL, 'deleted' FROM GO UNION ALL SELECT DISTINCT f.kind, f.id, f.field, 'nullified' FROM RF f JOIN GO ON f.policy = 'nullify' AND f.ref_kind = GO.kind AND f.ref_id = GO.id WHERE NOT EXISTS (SELECT 1 FROM GO o WHERE o.kind = f.kind AND o.id = f.id)""")
def delete_plan(spark, sf):  # noqa: ANN001, ANN201
    """Customers to be deleted, through references in circles with all three policies."""
    ensure(spark)
    starts = table(spark, sf, "customer").where("c_custkey % 10 = 0").select(F.lit("customer").alias("kind"), F.col("c_custkey").cast("long").alias("id"))
    outcomes, effects = lifecycle.delete_plan(starts, _references(spark, sf))
    return outcomes.select("kind", "id", F.lit("start").alias("field"), F.col("outcome").alias("effect")).unionByName(effects)


@query(sql(WORKSPACES, select="SELECT min(project_id) AS id, '/z/' || (k // 3) AS root_path FROM R WHERE k // 3 % 8 > 2 GROUP BY 2"))
def create_projects(spark, sf):  # noqa: ANN001, ANN201
    r = workspaces(spark, sf).select(F.col("project_id").alias("id"), F.concat(F.lit("/z/"), F.expr("cast(k div 3 as string)")).alias("root_path"), "k")
    return projects.create_projects(r.where("k div 3 % 8 <= 2"), r.drop("k")).select("id", "root_path")


@query(sql(WORKSPACES, "B AS (SELECT project_id AS id, k % 4 AS v, 'active' AS status FROM R WHERE k % 5 <> 1)", "A AS (SELECT project_id AS id, CASE WHEN k % 3 = 0 THEN 9 ELSE k % 4 END AS v, CASE WHEN k % 7 = 0 THEN 'archived' ELSE 'active' END AS status FROM R WHERE k % 5 <> 2)",
           select="SELECT A.id, CASE WHEN B.id IS NULL THEN 'created' WHEN A.status = 'archived' THEN 'archived' ELSE 'updated' END AS change, A.v, A.status FROM A LEFT JOIN B ON A.id = B.id WHERE B.id IS NULL OR A.v <> B.v OR A.status <> B.status"))
def project_changes(spark, sf):  # noqa: ANN001, ANN201
    r, k = workspaces(spark, sf), F.col("k")
    b = r.where(k % 5 != 1).select(F.col("project_id").alias("id"), (k % 4).alias("v"), F.lit("active").alias("status"))
    a = r.where(k % 5 != 2).select(F.col("project_id").alias("id"), F.when(k % 3 == 0, 9).otherwise(k % 4).alias("v"), F.when(k % 7 == 0, "archived").otherwise("active").alias("status"))
    return tables.changes(b, a)


#: Every reserved entity and field, and names that are none.
ENTITY_NAMES = [*validation.RESERVED_ENTITIES, "Card", "card_x", "Deck2"]
FIELD_NAMES = [*validation.RESERVED_FIELDS, "_type", "due_date", "dueDate", "x1"]
NAMESPACES = ["system", "shared", "com.app", "system.sub"]
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
DECLARED = f"""DC AS (SELECT {_list(NAMESPACES)}[p_partkey % {len(NAMESPACES)} + 1] AS namespace, CASE WHEN p_partkey % 3 = 0 THEN 'com.first' ELSE 'com.other' END AS owner, {_list(ENTITY_NAMES)}[p_partkey % {len(ENTITY_NAMES)} + 1] AS entity, CASE WHEN p_partkey % 31 <> 0 THEN {_list(FIELD_NAMES)}[p_partkey % {len(FIELD_NAMES)} + 1] END AS field FROM part)"""


def _declared(spark, sf):  # noqa: ANN001, ANN202
    k = F.col("p_partkey")
    of = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), (k % len(xs)).cast("int"))
    return table(spark, sf, "part").select(of(NAMESPACES).alias("namespace"), F.when(k % 3 == 0, "com.first").otherwise("com.other").alias("owner"), of(ENTITY_NAMES).alias("entity"), F.when(k % 31 != 0, of(FIELD_NAMES)).alias("field"))


@query(sql(DECLARED, select=f"""SELECT namespace, entity, field, problem FROM (SELECT *, unnest(list_filter([CASE WHEN namespace = 'system' OR namespace = 'shared' AND owner <> 'com.first' THEN 'reserved_namespace' END, CASE WHEN entity NOT IN ('Card', 'card_x', 'Deck2') THEN 'reserved_entity' END, CASE WHEN entity = 'card_x' THEN 'entity_case' END,
 CASE WHEN field IN ({_list(validation.RESERVED_FIELDS)[1:-1]}) THEN 'reserved_field' END, CASE WHEN field IN ('dueDate', '_type') THEN 'field_case' END], lambda x: x IS NOT NULL)) AS problem FROM DC)"""))
def schema_lint(spark, sf):  # noqa: ANN001, ANN201
    return validation.lint(_declared(spark, sf), ["com.first"])


SYSTEM_TYPES = ["File", "App", "Session", "Event", "UserAction", "Summary", "Project"]


@query(sql(DECLARED, select=f"SELECT namespace || '.' || entity AS type, count(DISTINCT field) AS fields FROM DC GROUP BY 1 UNION ALL SELECT t, 0 FROM (SELECT unnest({_list([f'system.{x}' for x in SYSTEM_TYPES])}) AS t) WHERE t NOT IN (SELECT namespace || '.' || entity FROM DC)"))
def type_catalogue(spark, sf):  # noqa: ANN001, ANN201
    return validation.type_catalogue(_declared(spark, sf), SYSTEM_TYPES)


@query(sql(DECLARED, "WT AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'com.app.Card' WHEN c_custkey % 3 = 1 THEN 'system.Summary' ELSE 'com.none.N' || c_nationkey END AS type FROM customer)", select="SELECT id, type, type IN (SELECT namespace || '.' || entity FROM DC) OR type = 'system.Summary' AS known FROM WT"))
def types_known(spark, sf):  # noqa: ANN001, ANN201
    k = F.col("c_custkey")
    wanted = table(spark, sf, "customer").select(k.alias("id"), F.when(k % 3 == 0, "com.app.Card").when(k % 3 == 1, "system.Summary").otherwise(F.concat(F.lit("com.none.N"), F.col("c_nationkey").cast("string"))).alias("type"))
    return validation.types_known(wanted, validation.type_catalogue(_declared(spark, sf), SYSTEM_TYPES))


@query("""WITH R AS (SELECT 'r' || o_orderkey AS relation, CASE WHEN o_orderstatus = 'F' THEN 'Card' ELSE 'com.b.Deck' END AS f, CASE WHEN o_orderkey % 5 = 0 THEN 'Lost' ELSE 'com.b.Deck' END AS t FROM orders)
 SELECT relation, 'to' AS "end", t AS type FROM R WHERE t = 'Lost'""")
def relation_ends(spark, sf):  # noqa: ANN001, ANN201
    o = table(spark, sf, "orders")
    r = o.select(F.lit("com.a").alias("namespace"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("relation"), F.when(F.col("o_orderstatus") == "F", "Card").otherwise("com.b.Deck").alias("from_type"), F.when(F.col("o_orderkey") % 5 == 0, "Lost").otherwise("com.b.Deck").alias("to_type"))
    known = o.select(F.when(F.col("o_orderkey") % 2 == 0, "com.a.Card").otherwise("com.b.Deck").alias("_type")).distinct()
    return validation.relation_ends(r, known)


@query("SELECT DISTINCT a AS src_id, b AS dst_id FROM (SELECT l_orderkey AS a, l_suppkey AS b FROM lineitem UNION ALL SELECT l_suppkey, l_orderkey FROM lineitem)")
def symmetric_edges(spark, sf):  # noqa: ANN001, ANN201
    return validation.symmetric(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src_id"), F.col("l_suppkey").alias("dst_id")))


@query("SELECT 'src' AS side, l_orderkey AS id, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 2 HAVING count(DISTINCT l_partkey) > 1 UNION ALL SELECT 'dst', l_partkey, count(DISTINCT l_orderkey) FROM lineitem GROUP BY 2 HAVING count(DISTINCT l_orderkey) > 1")
def cardinality_check(spark, sf):  # noqa: ANN001, ANN201
    return validation.cardinality(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src_id"), F.col("l_partkey").alias("dst_id")), "one_to_one")


@query("SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def unique_check(spark, sf):  # noqa: ANN001, ANN201
    return validation.duplicates_of(table(spark, sf, "part"), ["p_name", "p_brand"])


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'type' WHEN p_partkey % 5 = 0 THEN 'required' WHEN p_partkey % 4 = 0 THEN 'unknown' WHEN p_partkey % 3 = 0 THEN 'mismatch' END AS problem, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 'title' WHEN p_partkey % 4 = 0 THEN 'extra' ELSE 'count' END AS field
 FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 5 = 0 OR p_partkey % 4 = 0 OR p_partkey % 3 = 0""")
def corrupt_entities(spark, sf):  # noqa: ANN001, ANN201
    k = F.col("p_partkey")
    parts = [F.when(k % 5 != 0, F.concat(F.lit('"title": "'), "p_name", F.lit('"'))), F.when(k % 4 == 0, F.lit('"extra": 1')), F.concat(F.lit('"count": '), F.when(k % 3 == 0, "2.5").otherwise("2")), F.lit('"tags": []'), F.lit('"score": 2')]
    rows = table(spark, sf, "part").select(k.alias("id"), F.when(k % 7 == 0, "Other").otherwise("Note").alias("_type"), F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).alias("data"))
    one = table(spark, sf, "part").agg(F.min("p_partkey").alias("k"))
    spec = [("title", "string", True, None), ("body", "text", False, None), ("count", "int", False, None), ("tags", "string[]", False, None), ("score", "float", True, "1.0")]
    f = F.explode(F.array(*[F.struct(F.lit(a).alias("field"), F.lit(b).alias("kind"), F.lit(c).alias("required"), F.lit(d).cast("string").alias("default")) for a, b, c, d in spec]))
    fields = one.select(f.alias("f")).select(F.lit("Note").alias("_type"), "f.*", F.lit(False).alias("immutable"))
    return validation.validate(rows, fields)


CONFIG_VALUES = {
    "name": ["Work", "  ", None], "status": ["active", "archived", "odd", None], "accent_color": ["#aBc", "#12345", "#0a1b2c", "red", None],
    "provider": [*validation.PROVIDERS, "github", "none", None], "context_scope": [*validation.CONTEXT_SCOPES, "session", "none", None],
}
CONFIGS = "CF AS (SELECT c_custkey AS id, " + ", ".join(f"[{', '.join(_text(x) for x in xs)}][(c_custkey // {d}) % {len(xs)} + 1] AS {c}" for d, (c, xs) in zip((1, 2, 5, 11, 17), CONFIG_VALUES.items(), strict=True)) + " FROM customer)"


def _configs(spark, sf):  # noqa: ANN001, ANN202
    k = F.col("c_custkey")
    of = lambda d, xs: F.get(F.array(*[F.lit(x).cast("string") for x in xs]), (F.floor(k / d) % len(xs)).cast("int"))
    return table(spark, sf, "customer").select(k.alias("id"), *[of(d, xs).alias(c) for d, (c, xs) in zip((1, 2, 5, 11, 17), CONFIG_VALUES.items(), strict=True)])


@query(sql(CONFIGS, select="""SELECT id, CASE WHEN coalesce(trim(name), '') = '' THEN 'name' WHEN status = 'odd' THEN 'status' WHEN accent_color IN ('#12345', 'red') THEN 'accent_color' WHEN provider IN ('github', 'none') THEN 'provider' WHEN context_scope IN ('session', 'none') THEN 'context_scope' END AS problem FROM CF"""))
def config_check(spark, sf):  # noqa: ANN001, ANN201
    return validation.check_config(_configs(spark, sf)).select("id", "problem")


@query(sql(CONFIGS, select="SELECT id, name, coalesce(status, 'active') AS status, coalesce(context_scope, 'project') AS context_scope, '.' AS root, 'node_modules|target|.git|dist|build|__pycache__|*.pyc|.next|vendor' AS exclude, 0 AS included, CASE WHEN id % 3 = 0 THEN '2024-01-02' END AS created, 'main' AS default_branch FROM CF"))
def config_defaults(spark, sf):  # noqa: ANN001, ANN201
    d = validation.config_defaults(_configs(spark, sf).withColumn("created", F.when(F.col("id") % 3 == 0, F.lit("2024-01-02").cast("date"))))
    return d.select("id", "name", "status", "context_scope", "root", F.array_join("exclude", "|").alias("exclude"), F.size("include").alias("included"), "created", "default_branch")


EXECUTABLES = ["/usr/lib/acme/apps/org.n{0}/bin/run", "/home/u{0}/.local/share/acme/apps/com.n{0}/x", "/opt/acme-ai-daemon", "/usr/bin/acme-ai", "/usr/bin/acme-shell{0}", "/src/target/debug/tool{0}", "/usr/lib/acme/apps/", "/usr/bin/other{0}", ""]
EXECUTABLE_IDS = ["org.n{0}", "com.n{0}", "ai-daemon", "ai-daemon", "system", "dev.tool{0}", None, None, None]


@query("SELECT c_custkey AS id, replace([" + ", ".join(_text(x) for x in EXECUTABLE_IDS) + f"][c_custkey % {len(EXECUTABLES)} + 1], '{{0}}', CAST(c_nationkey AS VARCHAR)) AS app FROM customer")
def app_ids(spark, sf):  # noqa: ANN001, ANN201
    k = F.col("c_custkey")
    path = F.replace(F.get(F.array(*[F.lit(x) for x in EXECUTABLES]), (k % len(EXECUTABLES)).cast("int")), F.lit("{0}"), F.col("c_nationkey").cast("string"))
    return table(spark, sf, "customer").select(k.alias("id"), X.app_of_executable(path, "acme", development=True).alias("app"))


@query(sql(WORKSPACES, select="SELECT project_id AS id, root_path, CASE WHEN k % 3 <> 0 THEN 'active' ELSE 'shown' END AS list FROM R WHERE k % 4 <> 0"))
def active_projects(spark, sf):  # noqa: ANN001, ANN201
    k = F.col("k")
    p = workspaces(spark, sf).select(F.col("project_id").alias("id"), "root_path", F.when(k % 4 == 0, "archived").otherwise("active").alias("status"), (k % 3 == 0).alias("promoted"))
    shown = projects.active_projects(p, promoted=True).withColumn("list", F.lit("shown"))
    return projects.active_projects(p).where("not promoted").withColumn("list", F.lit("active")).unionByName(shown).select("id", "root_path", "list")


@query(sql(WORKSPACES, select="SELECT project_id AS id, root_path, 'path' AS by FROM R WHERE k % 3 = 0 UNION ALL SELECT project_id, root_path, 'id' FROM R WHERE k % 5 = 0"))
def project_lookup(spark, sf):  # noqa: ANN001, ANN201
    r = workspaces(spark, sf)
    p = r.select(F.col("project_id").alias("id"), "root_path")
    by_path, by_id = r.where("k % 3 = 0").select("root_path"), r.where("k % 5 = 0").select(F.col("project_id").alias("id"))
    return projects.lookup(p, by_path, "root_path").select("id", "root_path", F.lit("path").alias("by")).unionByName(projects.lookup(p, by_id).select("id", "root_path", F.lit("id").alias("by")))


@query("""WITH B AS (SELECT c_custkey AS id, 'seg.' || lower(c_mktsegment) || CASE WHEN c_custkey % 13 = 0 THEN '.Odd' ELSE '.Card' END AS t, 'seg.' || lower(CASE WHEN c_custkey % 7 = 0 THEN 'OTHER' ELSE c_mktsegment END) AS app FROM customer)
 SELECT id, CASE WHEN app LIKE '%automobile' THEN 'scope' WHEN NOT starts_with(t, app || '.') THEN 'namespace' WHEN t LIKE '%.Odd' THEN 'type' WHEN id % 5 = 0 THEN 'required' WHEN id % 4 = 0 THEN 'unknown' WHEN id % 3 = 0 THEN 'mismatch' END AS reject,
 CASE WHEN app LIKE '%automobile' OR NOT starts_with(t, app || '.') OR t LIKE '%.Odd' THEN NULL WHEN id % 5 = 0 THEN 'title' WHEN id % 4 = 0 THEN 'extra' WHEN id % 3 = 0 THEN 'count' END AS field FROM B""")
def create_checked(spark, sf):  # noqa: ANN001, ANN201
    k = F.col("c_custkey")
    kind = F.concat(F.lit("seg."), F.lower("c_mktsegment"), F.when(k % 13 == 0, ".Odd").otherwise(".Card"))
    app = F.concat(F.lit("seg."), F.lower(F.when(k % 7 == 0, F.lit("OTHER")).otherwise(F.col("c_mktsegment"))))
    data = F.concat(F.lit("{"), F.concat_ws(", ", F.when(k % 5 != 0, F.lit('"title": "t"')), F.when(k % 4 == 0, F.lit('"extra": 1')), F.concat(F.lit('"count": '), F.when(k % 3 == 0, "2.5").otherwise("2"))), F.lit("}"))
    b = table(spark, sf, "customer").select(k.alias("id"), kind.alias("_type"), app.alias("app"), data.alias("data"))
    spec = F.explode(F.array(F.struct(F.lit("title").alias("field"), F.lit("string").alias("kind"), F.lit(True).alias("required")), F.struct(F.lit("count").alias("field"), F.lit("int").alias("kind"), F.lit(False).alias("required"))))
    fields = b.where("_type like '%.Card'").select("_type").distinct().select("_type", spec.alias("f")).select("_type", "f.*", F.lit(None).cast("string").alias("default"), F.lit(False).alias("immutable"))
    return lifecycle.create_checked(b, b.where("app not like '%automobile'").select("app", "_type"), fields, _now()).select("id", "reject", "field")


_SEG = "'seg.' || lower(c_mktsegment)"
_PATCH = {"created": "c_custkey % 5 = 0", "extra": "c_custkey % 7 = 0", "float": "c_custkey % 8 = 0"}


@query(f"""WITH B AS (SELECT c_custkey AS id, c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'seg.furniture' WHEN c_custkey % 11 = 0 THEN 'seg.household' ELSE {_SEG} END AS app, {_SEG} AS owner, c_custkey % 4 + 1 AS v, CASE WHEN c_custkey % 6 = 0 THEN 9 ELSE c_custkey % 4 + 1 END AS ev FROM customer),
 C AS (SELECT *, CASE WHEN id % 13 = 0 THEN 'missing' WHEN app = 'seg.furniture' THEN 'scope' WHEN app <> 'seg.household' AND app <> owner THEN 'owner' WHEN v <> ev THEN 'version' WHEN {_PATCH['created']} THEN 'immutable' WHEN {_PATCH['extra']} THEN 'unknown' WHEN {_PATCH['float']} THEN 'mismatch' END AS reject FROM B),
 K AS (SELECT *, reject IS NULL AS ok FROM C)
 SELECT id, 1 AS "order", reject, CASE reject WHEN 'immutable' THEN 'created' WHEN 'unknown' THEN 'extra' WHEN 'mismatch' THEN 'count' END AS field, CASE WHEN ok THEN v + 1 END AS version, CASE WHEN ok THEN id + 1 END AS count, CASE WHEN ok THEN 't' || id END AS title FROM K
 UNION ALL SELECT id, 2, CASE WHEN reject IN ('missing', 'scope', 'owner') THEN reject ELSE 'version' END, NULL, NULL, NULL, NULL FROM K WHERE id % 10 = 1""")
def update_checked(spark, sf):  # noqa: ANN001, ANN201
    """Updates of customers' cards judged by row, scope, owner, version and declared fields; some are asked for twice."""
    k, c = F.col("c_custkey"), table(spark, sf, "customer")
    seg = F.concat(F.lit("seg."), F.lower("c_mktsegment"))
    data = F.to_json(F.struct(F.concat(F.lit("t"), k.cast("string")).alias("title"), k.alias("count")))
    current = c.where("c_custkey % 13 <> 0").select(k.alias("id"), F.lit("seg.Card").alias("_type"), seg.alias("_owner"), (k % 4 + 1).cast("bigint").alias("_version"), data.alias("data"))
    patch = F.when(F.expr(_PATCH["created"]), F.lit('{"created": "x"}')).when(F.expr(_PATCH["extra"]), F.lit('{"extra": 1}')).when(F.expr(_PATCH["float"]), F.lit('{"count": 2.5}')).otherwise(F.to_json(F.struct((k + 1).alias("count"))))
    app = F.when(k % 9 == 0, "seg.furniture").when(k % 11 == 0, "seg.household").otherwise(seg)
    asked = c.select(k.alias("id"), app.alias("app"), F.when(k % 6 == 0, 9).otherwise(k % 4 + 1).cast("bigint").alias("expected_version"), F.lit(1).alias("order"), patch.alias("data"))
    asked = asked.unionByName(asked.where("id % 10 = 1").withColumn("order", F.lit(2)))
    scopes = asked.select("app").distinct().where("app <> 'seg.furniture'").select("app", F.lit("seg.Card").alias("_type"), F.when(F.col("app") == "seg.household", "all").otherwise("own").alias("scope"))
    fields = spark.createDataFrame([("seg.Card", "title", "string", True, None, False), ("seg.Card", "count", "int", False, None, False), ("seg.Card", "created", "string", False, None, True)], "_type string, field string, kind string, required boolean, default string, immutable boolean")
    d = lifecycle.update_checked(current, asked, scopes, fields, _now())
    return d.select("id", "order", "reject", "field", F.col("_version").alias("version"), F.get_json_object("data", "$.count").cast("bigint").alias("count"), F.get_json_object("data", "$.title").alias("title"))


ASKED = "RQ AS (SELECT CASE WHEN id % 19 = 0 THEN id + 10000000 ELSE id END AS id, CASE WHEN id % 9 = 0 THEN 'OTHER' ELSE _owner END AS app FROM P)"
SCOPED = "CASE WHEN P.id IS NULL THEN 'missing' WHEN app = 'FURNITURE' THEN 'scope' WHEN app <> 'BUILDING' AND P._owner <> app THEN 'owner' WHEN {0} THEN '{1}' END"


@query(sql(PEOPLE, ASKED, select=f"SELECT RQ.id, 'delete' AS action, {SCOPED.format('P._deleted', 'deleted')} AS reject FROM RQ LEFT JOIN P USING (id) UNION ALL SELECT RQ.id, 'restore', CASE WHEN NOT P._deleted THEN 'not_deleted' ELSE {SCOPED.format('FALSE', '')} END FROM RQ LEFT JOIN P USING (id)"))
def trash_answers(spark, sf):  # noqa: ANN001, ANN201
    p = people(spark, sf)
    r, scopes = _asked(p)
    parts = [lifecycle.answers(r, p, scopes, deleted).select("id", F.lit(name).alias("action"), "reject") for name, deleted in (("delete", False), ("restore", True))]
    return parts[0].unionByName(parts[1])


@query(sql(PEOPLE, ASKED, f"DL AS (SELECT RQ.id FROM RQ JOIN P USING (id) WHERE {SCOPED.format('P._deleted', 'deleted')} IS NULL)", f"RS AS (SELECT RQ.id FROM RQ JOIN P USING (id) WHERE P._deleted AND {SCOPED.format('FALSE', '')} IS NULL)",
           select="SELECT P.id, CASE WHEN P.id IN (SELECT id FROM DL) THEN TRUE WHEN P.id IN (SELECT id FROM RS) THEN FALSE ELSE P._deleted END AS deleted, P._version + CAST(P.id IN (SELECT id FROM RS) AS BIGINT) AS version FROM P"))
def trash_applied(spark, sf):  # noqa: ANN001, ANN201
    """The people after all restores, then all deletes, that scopes, owners and states let through; both are asked of the same state."""
    p = people(spark, sf)
    r, scopes = _asked(p)
    back, _ = lifecycle.answered(p, r, scopes, True, _now())
    gone = lifecycle.answers(r, p, scopes, False).where("reject is null").select("id", "_type", "app")
    after, _ = lifecycle.answered(back, gone, scopes, False, _now())
    return after.select("id", F.col("_deleted").alias("deleted"), F.col("_version").alias("version"))


def _asked(p):  # noqa: ANN001, ANN202
    """Requests for all people, some of them unknown or by another app, and what the apps may do."""
    i = F.col("id")
    r = p.select(F.when(i % 19 == 0, i + 10000000).otherwise(i).alias("id"), "_type", F.when(i % 9 == 0, "OTHER").otherwise(F.col("_owner")).alias("app"))
    scopes = r.select("app", "_type").distinct().where("app <> 'FURNITURE'").withColumn("scope", F.when(F.col("app") == "BUILDING", "all").otherwise("own"))
    return r, scopes


@query("SELECT type, count(*) AS n FROM (SELECT 'Person' AS type FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'Organization' FROM supplier WHERE s_acctbal >= 0) GROUP BY 1")
def export_manifest(spark, sf):  # noqa: ANN001, ANN201
    a = people(spark, sf).select("id", "_type", "_deleted")
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("Organization").alias("_type"), (F.col("s_acctbal") < 0).alias("_deleted"))
    return export.manifest(export.select_export(a.unionByName(b))).select(F.col("_type").alias("type"), "n")


@query("SELECT c_custkey AS id, 'Person' AS type FROM customer WHERE c_mktsegment = 'BUILDING'")
def export_filtered(spark, sf):  # noqa: ANN001, ANN201
    both = people(spark, sf).select("id", "_type", "_owner", "_deleted").unionByName(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("Organization").alias("_type"), F.lit("BUILDING").alias("_owner"), F.lit(False).alias("_deleted")))
    return export.select_export(both, "BUILDING", ["Person"], include_deleted=True).select("id", F.col("_type").alias("type"))


def _agents(spark, sf):  # noqa: ANN001, ANN202
    """Customers and suppliers as entities of two types."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.lit("Organization").alias("_type"), F.col("s_name").alias("name"))
    return people(spark, sf).select(F.col("id").cast("long").alias("id"), "_type", "name").unionByName(s)


AGENTS = "(SELECT CAST(c_custkey AS BIGINT) AS id, 'Person' AS type, c_name AS name FROM customer UNION ALL SELECT s_suppkey, 'Organization', s_name FROM supplier)"


@query(f"SELECT type, (row_number() OVER (PARTITION BY type ORDER BY id) - 1) // 100 AS part, id, name FROM {AGENTS}")
def export_linked(spark, sf):  # noqa: ANN001, ANN201
    d = export.linked_documents(_agents(spark, sf), "https://example.org", "id", 100)
    read = F.from_json("document", "`@type` string, `@graph` array<struct<id: bigint, name: string>>")
    return d.select("part", read.alias("d")).select(F.col("d.`@type`").alias("type"), "part", F.inline("d.`@graph`"))


@query(f"SELECT id, type, name FROM {AGENTS}")
def export_import(spark, sf):  # noqa: ANN001, ANN201
    path = f"{ensure(spark).rstrip('/')}/export-{uuid.uuid4().hex}"
    export.export(_agents(spark, sf), path)
    back, off = export.import_entities(spark, path, "id bigint, name string, _type string")
    return back.join(off, "_type", "left_anti").select("id", F.col("_type").alias("type"), "name")


@query(sql(PEOPLE, select="SELECT id, name FROM P"))
def readable_columns(spark, sf):  # noqa: ANN001, ANN201
    return people(spark, sf).select(access.readable_fields(["id", "name", "_owner"], [["id", "name"], None]))


@query(r"""SELECT page_id, array_to_string(string_split(regexp_replace(url, '/+$', ''), '/')[-2:], '/') AS tail, nullif(regexp_extract(host, '^(.+)\.([^.]+)$', 1), '') AS namespace, nullif(regexp_extract(host, '^(.+)\.([^.]+)$', 2), '') AS name
 FROM (SELECT *, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages)""")
def type_names(spark, sf):  # noqa: ANN001, ANN201
    p = table(spark, sf, "pages").withColumn("host", F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)))
    namespace, name = X.split_type(F.col("host"))
    return p.select("page_id", X.last_components(F.col("url"), 2).alias("tail"), namespace.alias("namespace"), name.alias("name"))


@query(sql(E, select=f"""SELECT id, "timestamp" // {DAY} * {DAY} AS day_start, "timestamp" // {DAY} * {DAY} + {DAY} AS day_end, nullif("timestamp" // 1000 * (k % 2), 0) * 1000 AS made_us FROM E"""))
def day_ranges(spark, sf):  # noqa: ANN001, ANN201
    e = activity(spark, sf)
    start, end = X.day_range(X.micros_to_date(F.col("timestamp")))
    made = X.millis_to_timestamp(F.floor(F.col("timestamp") / 1000) * (F.col("k") % 2))
    return e.select("id", start.alias("day_start"), end.alias("day_end"), F.unix_micros(made).alias("made_us"))


@query("SELECT event_id, lower(json_type(props)) AS whole, CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'number' WHEN 'VARCHAR' THEN 'string' ELSE 'other' END AS k, coalesce(lower(json_type(props, '$.absent')), 'null') AS absent FROM events")
def json_kinds(spark, sf):  # noqa: ANN001, ANN201
    v = F.parse_json("props")
    kind = lambda path: X.json_kind(F.variant_get(v, path, "variant"))
    return table(spark, sf, "events").select("event_id", X.json_kind(v).alias("whole"), kind("$.k").alias("k"), kind("$.absent").alias("absent"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'archived' ELSE 'active' END AS status FROM orders")
def project_states(spark, sf):  # noqa: ANN001, ANN201
    s = F.when(F.col("o_orderstatus") == "F", "archived").when(F.col("o_orderstatus") == "O", "paused")
    return table(spark, sf, "orders").select("o_orderkey", X.project_status(s).alias("status"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_size || '.' || (p_partkey % 7) END AS source, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE (p_size + 1) || '.0' END AS target FROM part")
def migration_files(spark, sf):  # noqa: ANN001, ANN201
    k, size = F.col("p_partkey"), F.col("p_size")
    name = F.concat(size.cast("string"), F.lit("."), (k % 7).cast("string"), F.lit("_to_"), (size + 1).cast("string"), F.when(k % 3 == 0, ".0.json").otherwise(".0.toml"))
    source, target = X.migration_versions(name)
    return table(spark, sf, "part").select("p_partkey", source.alias("source"), target.alias("target"))


@query(r"SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, CASE WHEN regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^.+(\.[^.]*)$', 1) = '' THEN regexp_extract(url, '([^/]*)$', 1) ELSE regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^(.+)\.[^.]*$', 1) END AS stem, regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^.+(\.[^.]*)$', 1) AS ext, coalesce(nullif(regexp_replace(url, '[^A-Za-z0-9_.-]', '-', 'g'), ''), 'unnamed') AS dir, nullif(regexp_extract(regexp_replace(url, '\.git$', ''), '([^/:]+)$', 1), '') AS repo FROM pages")
def path_helpers(spark, sf):  # noqa: ANN001, ANN201
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", X.basename(u).alias("base"), X.stem(u).alias("stem"), X.extension(u).alias("ext"), X.sanitize_dirname(u).alias("dir"), X.repo_name(u).alias("repo"))


@query(sql(WORKSPACES, select=f"""SELECT project_id AS id, CASE WHEN k % 4 = 1 THEN upper(project_id) ELSE project_id END AS name, root_path, CASE WHEN k % 3 = 0 THEN 'archived' ELSE 'active' END AS status, CASE WHEN k % 3 = 0 THEN {NOW} END AS archived_at,
 inferred AND k % 8 = 0 AS promoted, CASE WHEN k % 2 = 0 THEN {NOW} ELSE k END AS last_accessed FROM R WHERE k % 7 <> 0"""))  # fmt: skip
def change_projects(spark, sf):  # noqa: ANN001, ANN201
    r, k = workspaces(spark, sf), F.col("k")
    p = r.select(F.col("project_id").alias("id"), F.col("project_id").alias("name"), "root_path", F.lit("active").alias("status"), F.lit(None).cast("long").alias("archived_at"), F.lit(False).alias("promoted"), k.cast("long").alias("last_accessed"))
    act = lambda hit, name: r.where(hit).select(F.col("project_id").alias("id"), F.lit(name).alias("action"), F.upper("project_id").alias("name"), F.lit("/never").alias("root_path"))
    c = act(k % 4 == 1, "update").unionByName(act(k % 3 == 0, "archive")).unionByName(act(k % 8 == 0, "promote")).unionByName(act(k % 2 == 0, "touch")).unionByName(act(k % 7 == 0, "delete"))
    return projects.change_projects(p, c, F.lit(NOW))


@query("SELECT o_orderkey AS src_id, o_custkey AS dst_id FROM orders WHERE o_custkey % 5 <> 0")
def unlink_files(spark, sf):  # noqa: ANN001, ANN201
    return projects.unlink_files(_order_edges(spark, sf), people(spark, sf).where("id % 5 = 0"))


@query(sql(PEOPLE, f"X AS (SELECT id FROM P WHERE _deleted AND deleted_us < {NOW} - CASE WHEN nation % 2 = 0 THEN 50 ELSE 30 END * {DAY})", select="SELECT 'deleted' AS outcome, count(*) AS n FROM X UNION ALL SELECT 'nullified', count(*) FROM orders WHERE o_custkey IN (SELECT id FROM X)"))
def cleanup_run(spark, sf):  # noqa: ANN001, ANN201
    p = people(spark, sf).withColumn("_type", F.col("nation").cast("string"))
    days = p.where("nation % 2 = 0").select("_type", F.lit(50).alias("days")).distinct()
    orders = _order_edges(spark, sf)
    return lifecycle.cleanup(p, orders, orders.select(F.col("src_id").alias("id"), F.col("dst_id").alias("customer")), "customer", days, _now())[3]


@query("SELECT o_orderkey AS id FROM orders ORDER BY id LIMIT 10000")
def capped_result(spark, sf):  # noqa: ANN001, ANN201
    tiers = quota.assign_tiers(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("app")).distinct(), None, [], "first.")
    return quota.cap_rows(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")).orderBy("id"), tiers, "MACHINERY")
