"""Duplicate entities: blocked candidate search, suggestions, merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scalars import normalize_name, string_similarity

#: Fixed values by type: unique fields, fuzzy fields with their least likeness, least score.
CONFIGS: dict[str, tuple[list[str], dict[str, float], float]] = {
    "Person": (["email"], {"name": 0.85}, 0.8),
    "Organization": (["domain"], {"name": 0.9}, 0.85),
    "Location": (["place_id"], {"name": 0.9, "address": 0.85}, 0.8),
    "Tag": (["name"], {}, 1.0),
}


def score(a: str, b: str, unique: list[str], fuzzy: dict[str, float]) -> tuple[Column, Column]:
    """Score of two structs and the matched fields: over fields that both have, exact ones count 1, fuzzy ones their likeness if it is enough."""
    total, present, matched = F.lit(0.0), F.lit(0), []
    for f, least in [*dict.fromkeys(unique).items(), *fuzzy.items()]:
        x, y = F.col(f"{a}.{f}"), F.col(f"{b}.{f}")
        both = x.isNotNull() & y.isNotNull()
        s = F.when(x == y, 1.0).otherwise(0.0) if least is None else string_similarity(normalize_name(x), normalize_name(y))
        hit = s >= (1.0 if least is None else least)
        total, present = total + F.when(both & hit, s).otherwise(0.0), present + both.cast("int")
        matched.append(F.when(both & hit, F.lit(f)))
    return F.when(present > 0, total / present).otherwise(0.0), F.array_compact(F.array(*matched))


def _likely(classes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of distinct character sets c, a < b, at likeness `least` or more, as arrays.

    Of a set of m characters, any match at likeness t holds one of its m - ceil(t m) + 1 rarest, in one order of all characters. Sets
    are joined by each of these, the next one in that order, and their sizes: so a key is shared by few, and each pair is verified.
    """
    d = classes.select("c", F.size("c").alias("m"))
    freq = d.select(F.explode("c").alias("ch")).groupBy("ch").agg(F.count("*").alias("df"))
    order = d.select("c", "m", F.explode("c").alias("ch")).join(freq, "ch").groupBy("c", "m").agg(F.array_sort(F.collect_list(F.struct("df", "ch"))).alias("o"))  # an alphabet at most
    keys = order.select("c", "m", F.explode(F.slice("o", F.lit(1), (F.col("m") - F.ceil(F.col("m") * F.lit(least)) + 1).cast("int"))).alias("k")).select("c", "m", "k.ch")
    sizes = F.sequence(F.ceil(F.col("m") * F.lit(least)).cast("int"), F.col("m"))  # the smaller one's, seen from the larger one
    a = keys.select(F.col("c").alias("a"), "ch", F.explode(sizes).alias("n"))
    b = keys.select(F.col("c").alias("b"), "ch", F.col("m").alias("n"))
    both = F.size(F.array_intersect("a", "b"))
    near = a.join(b, ["ch", "n"]).where("a <> b").where(both >= F.lit(least) * (F.size("a") + F.size("b") - both))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _classes(d: DataFrame, unique: list[str], fuzzy: dict[str, float]) -> DataFrame:
    """Rows (id, e) by their unique fields u (an array, nulls kept) and the character sets of their fuzzy fields c (likewise): score is the same for all members of two classes."""
    sets = []
    for f in fuzzy:
        name = normalize_name(F.col(f"e.{f}"))
        sets.append(F.when(F.col(f"e.{f}").isNotNull(), F.array_sort(F.array_remove(F.array_distinct(F.split(F.lower(name), "")), ""))))
    return d.select("id", F.array(*[F.col(f"e.{f}").cast("string") for f in unique]).alias("u"), (F.array(*sets) if sets else F.array().cast("array<array<string>>")).alias("c"))


def candidates(entities: DataFrame, entity_type: str, reject: DataFrame | None = None) -> DataFrame:
    """(source_id, target_id, score, matched) of pairs of one type that score enough, source_id < target_id.

    All pairs that a comparison of each two rows would link are connected by the pairs returned, each of which is such a link; but n
    rows of equal fields give n - 1 pairs, not all. Rows of equal unique fields and equal character sets of names are one class. Two
    classes link if no field that both have differs and one agrees (any other outcome stays below the least score); so
    - members of a class meet its smallest id;
    - classes that share a unique value meet where their names are alike, and those without a name meet all of them;
    - classes of like names of which one lacks the unique fields meet: with one fuzzy field, each set of characters has a hub, the
      smallest id among classes without the unique fields of a like set, that meets all classes of the set, and every other class
      without them meets the set's smallest id; with several fuzzy fields all such classes meet.
    Every pair is verified by its score. reject: pairs that were turned down before, which are left out.
    """
    unique, fuzzy, least = CONFIGS[entity_type]
    fields = list(dict.fromkeys([*unique, *fuzzy]))
    if (len(fields) - 1) / len(fields) >= least > 0 and len(fields) > 1:
        raise ValueError(f"{entity_type}: a pair with a field that differs could score {least}")
    d = entities.select("id", F.struct(*fields).alias("e"))
    rows = _classes(d, unique, fuzzy)
    classes = rows.groupBy("u", "c").agg(F.min("id").alias("first"))
    pair = lambda x, y: (F.least(x, y).alias("source_id"), F.greatest(x, y).alias("target_id"))
    found = [rows.join(classes.select(F.col("u").alias("v"), F.col("c").alias("k"), "first"), F.col("u").eqNullSafe(F.col("v")) & F.col("c").eqNullSafe(F.col("k"))).where("id <> first").select(F.col("first").alias("source_id"), F.col("id").alias("target_id"))]
    lacks = lambda a: F.forall(a, lambda x: x.isNull())
    valued = classes.withColumn("value", F.explode(F.filter("u", lambda x: x.isNotNull())))
    wild = [*[F.get("c", F.lit(i)).isNull() for i in range(len(fuzzy))], lacks(F.col("c"))]
    for w in wild:
        rep = valued.where(w).groupBy(F.col("value").alias("shared")).agg(F.min("first").alias("rep"))
        found.append(valued.join(rep, F.col("value") == F.col("shared")).where("first <> rep").select(*pair("first", "rep")))
    for i, t in enumerate(fuzzy.values()):
        at = F.get("c", F.lit(i))
        near = _likely(classes.where(at.isNotNull()).select(at.alias("c")).distinct(), t)
        both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(classes.where(at.isNotNull()).select(at.alias("a"), at.alias("b")).distinct())
        x = valued.where(at.isNotNull()).select("value", at.alias("a"), F.col("first").alias("x"))
        y = valued.where(at.isNotNull()).select(F.col("value").alias("shared"), at.alias("k"), F.col("first").alias("y"))
        found.append(x.join(both, "a").join(y, (F.col("value") == F.col("shared")) & (F.col("b") == F.col("k"))).where("x < y").select(*pair("x", "y")))
        x = classes.where(at.isNotNull() & lacks(F.col("u"))).select(at.alias("a"), F.col("first").alias("x"))
        y = classes.where(at.isNotNull()).select(at.alias("k"), F.col("first").alias("y"))
        if len(fuzzy) == 1:
            hubs = x.join(both, "a").groupBy("b").agg(F.min("x").alias("x"))
            found.append(hubs.join(y, F.col("b") == F.col("k")).where("x <> y").select(*pair("x", "y")))
            y = y.groupBy("k").agg(F.min("y").alias("y"))
        found.append(x.join(both, "a").join(y, F.col("b") == F.col("k")).where("x <> y").select(*pair("x", "y")))
    pairs = reduce(DataFrame.unionByName, found)
    if reject is not None:
        pairs = pairs.join(reject.select("source_id", "target_id"), ["source_id", "target_id"], "left_anti")
    s, matched = score("x", "y", unique, fuzzy)
    full = pairs.distinct().join(d.select(F.col("id").alias("source_id"), F.col("e").alias("x")), "source_id").join(d.select(F.col("id").alias("target_id"), F.col("e").alias("y")), "target_id")
    return full.select("source_id", "target_id", s.alias("score"), matched.alias("matched")).where((F.col("score") >= least) & (F.size("matched") > 0))


def connected(links: DataFrame) -> DataFrame:
    """(id, root) of all ids of links (source_id, target_id): the smallest id that each is connected with.

    In each round every root meets its smallest neighbour among the roots, chains of these are followed to their end, and the links
    are carried over to what is left; rounds are few, as at least every second root with a link goes. Needs a checkpoint folder.
    """
    edges = links.select("source_id", "target_id").distinct().checkpoint()
    labels = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct().withColumn("root", F.col("id"))
    edges = edges.where("source_id <> target_id")
    while not edges.isEmpty():
        lower = edges.groupBy(F.greatest("source_id", "target_id").alias("source_id")).agg(F.min(F.least("source_id", "target_id")).alias("target_id"))
        m = keep_map(lower)
        labels = labels.join(m.withColumnRenamed("delete_id", "root"), "root", "left").select("id", F.coalesce("keep_id", "root").alias("root")).checkpoint()
        for c in ("source_id", "target_id"):
            edges = edges.join(m.select(F.col("delete_id").alias(c), F.col("keep_id").alias("__to")), c, "left").withColumn(c, F.coalesce("__to", c)).drop("__to")
        edges = edges.where("source_id <> target_id").distinct().checkpoint()
    return labels


def rejected(suggested: DataFrame, turned_down: DataFrame, now: Column) -> DataFrame:
    """Suggestions with those of turned_down (id) marked as rejected; `candidates` leaves such pairs out from then on."""
    d = suggested.join(turned_down.select("id").distinct().withColumn("__no", F.lit(True)), "id", "left")
    hit = F.col("__no").isNotNull() & (F.col("status") == "pending")
    return d.withColumns({"status": F.when(hit, "rejected").otherwise(F.col("status")), "decided_at": F.when(hit, now)}).drop("__no")


def suggestions(found: DataFrame, entity_type: str, now: Column) -> DataFrame:
    return found.select(F.sha1(F.concat_ws("|", "source_id", "target_id")).alias("id"), F.lit(entity_type).alias("entity_type"), "source_id", "target_id", "score", "matched", F.lit("pending").alias("status"), now.alias("created_at"))


def pending(suggested: DataFrame, limit: int, entity_type: str | None = None) -> DataFrame:
    d = suggested.where("status = 'pending'")
    if entity_type:
        d = d.where(F.col("entity_type") == entity_type)
    return d.orderBy(F.desc("created_at"), "id").limit(limit)


def keep_map(accepted: DataFrame) -> DataFrame:
    """(delete_id, keep_id) of accepted merges (source goes, target stays), chains followed to their end.

    Each round doubles the reach of a chain; a source that is named twice goes to the greater target.
    """
    m = accepted.groupBy(F.col("source_id").alias("delete_id")).agg(F.max("target_id").alias("keep_id")).where("delete_id <> keep_id")
    while True:
        nxt = m.select(F.col("delete_id").alias("keep_id"), F.col("keep_id").alias("further"))
        step = m.join(nxt, "keep_id", "left").select("delete_id", F.coalesce("further", "keep_id").alias("keep_id"), F.col("further").isNotNull().alias("moved")).where("delete_id <> keep_id").checkpoint()
        m = step.drop("moved")
        if step.where("moved").isEmpty():
            return m


def apply_merges(nodes: DataFrame, edges: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without merged ones, and edges moved to what they were merged into."""
    m = keep_map(accepted)
    e = edges.select("src_id", "dst_id")
    for c in ("src_id", "dst_id"):
        e = e.join(m.select(F.col("delete_id").alias(c), F.col("keep_id").alias("__to")), c, "left").withColumn(c, F.coalesce("__to", c)).drop("__to")
    return nodes.join(m.select(F.col("delete_id").alias("id")), "id", "left_anti"), e.select("src_id", "dst_id").distinct()
