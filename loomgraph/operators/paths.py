"""Path matching: nearest ancestors, common directories, project trees, fixed-length patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scalars import common_directory, last_components


def nearest_ancestor(paths: DataFrame, roots: DataFrame, boundary: str = "") -> DataFrame:
    """(path, project_id, root_path): of the roots that begin a path the longest; unmatched paths are left out.

    Each path is cut to every length that a root has and joined by equality, so no pair of a path and a root is compared but those
    that match. The lengths are few: no more than a path has characters. boundary '/': the root must end at a path separator.
    """
    lengths = [r[0] for r in roots.select(F.length("root_path").alias("n")).where("n > 0").distinct().orderBy("n").collect()]
    if not lengths:
        return paths.select("path", *[F.lit(None).cast(roots.schema[c].dataType).alias(c) for c in ("project_id", "root_path")]).limit(0)
    d = paths.select("path").where("path is not null").distinct().select("path", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("n")).where(F.length("path") >= F.col("n"))
    d = d.select("path", F.substring("path", F.lit(1), F.col("n")).alias("root_path"), "n")
    if boundary:
        after = F.substring("path", F.col("n") + 1, F.lit(1))
        d = d.where((after == "") | (after == boundary) | F.col("root_path").endswith(boundary))
    d = d.join(roots.select("project_id", "root_path"), "root_path")
    best = F.max_by(F.struct("project_id", "root_path"), F.struct("n", "project_id"))
    return d.groupBy("path").agg(best.alias("best")).select("path", "best.*")


def nearest_as_of(points: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, at, project_id, root_path): for each path and time, of the roots that begin the path and stood then the longest, ties by project_id.

    roots: (project_id, root_path, created_at, archived_at); both ends count, without archived_at a root still stands, without created_at it
    always did. An interval is cut into a few slices of a width (a power of two) that fits its length, and a point meets it in the
    slice of that width that it lies in: the join is by equality on root, width and slice, then the ends are compared. A root that
    has stood for long has no more rows than a short-lived one, and a long history no more than a short one.
    """
    last, first = 1 << 62, -(1 << 62)
    r = roots.select("project_id", "root_path", F.coalesce("created_at", F.lit(first)).alias("start"), F.coalesce("archived_at", F.lit(last)).alias("end")).where("start <= end and length(root_path) > 0")
    width = F.greatest(F.ceil(F.log2((F.col("end").cast("double") - F.col("start").cast("double")) / 4 + 1)).cast("int"), F.lit(0))
    r = r.withColumn("width", F.least(width, F.lit(61)))
    cut = lambda c: F.expr(f"shiftright({c}, width)")
    r = r.select("project_id", "root_path", F.length("root_path").alias("n"), "start", "end", "width", F.explode(F.sequence(cut("start"), cut("end"))).alias("slice"))
    shapes = [(x[0], x[1]) for x in r.select("n", "width").distinct().collect()]  # lengths of paths times 62 widths at most
    named = points.select("path", "at").where("path is not null and at is not null").distinct()
    if not shapes:
        return named.select("path", "at", *[F.lit(None).cast(roots.schema[c].dataType).alias(c) for c in ("project_id", "root_path")]).limit(0)
    d = named.select("path", "at", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(w).alias("width")) for n, w in shapes])).alias("s")).select("path", "at", "s.*").where(F.length("path") >= F.col("n"))
    d = d.select("path", "at", F.substring("path", F.lit(1), F.col("n")).alias("root_path"), "width", cut("at").alias("slice"))
    d = d.join(r, ["root_path", "width", "slice"]).where("at between start and end")
    best = F.max_by(F.struct("project_id", "root_path"), F.struct("n", "project_id"))
    return d.groupBy("path", "at").agg(best.alias("best")).select("path", "at", "best.*")


def directory_of_all(paths: DataFrame, by: list[str]) -> DataFrame:
    """(by, directory): the longest directory that all of a group's paths share, from its smallest and largest path."""
    g = paths.groupBy(*by).agg(F.min("path").alias("lo"), F.max("path").alias("hi"), F.countDistinct("path").alias("n"))
    return g.select(*by, common_directory(F.col("lo"), F.col("hi"), F.col("n")).alias("directory"))


def tree_path(path: Column, common: Column) -> Column:
    """A project root's place below what all roots share: the rest, its own name where nothing is left, its last two names where nothing is shared."""
    rest = F.when(path == common, F.regexp_extract(path, r"([^/]*)$", 1)).otherwise(F.regexp_replace(F.expr("substring(path, length(directory) + 1)"), "^/+", ""))
    return F.when(common == "", last_components(path, 2)).otherwise(rest)


def project_tree(projects: DataFrame) -> DataFrame:
    """projects with their relative path in the tree."""
    top = directory_of_all(projects.where("root_path <> ''").select(F.col("root_path").alias("path"), F.lit(1).alias("all")), ["all"])
    d = projects.where("root_path <> '' and name <> ''").withColumn("all", F.lit(1)).join(F.broadcast(top), "all").drop("all")  # one row
    return d.withColumn("path", F.col("root_path")).withColumn("relative", tree_path(F.col("path"), F.col("directory"))).drop("path", "directory")


def tree_children(tree: DataFrame) -> DataFrame:
    """(prefix, kind, name) of every level: sub-directories, each once, and leaves."""
    parts = F.split("relative", "/")
    d = tree.select("relative", parts.alias("p")).select("relative", "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("i"))
    prefix = F.array_join(F.slice("p", F.lit(1), F.col("i") - 1), "/")
    kind = F.when(F.col("i") == F.size("p"), "leaf").otherwise("dir")
    return d.select(prefix.alias("prefix"), kind.alias("kind"), F.get("p", F.col("i") - 1).alias("name")).distinct()


def match_path(edges: list[tuple[DataFrame, str]]) -> DataFrame:
    """Pattern of fixed length: columns n0, n1, ... along edges (src_id, dst_id), each followed 'out' or 'in'."""
    out = None
    for i, (e, way) in enumerate(edges):
        a, b = ("src_id", "dst_id") if way == "out" else ("dst_id", "src_id")
        step = e.select(F.col(a).alias(f"n{i}"), F.col(b).alias(f"n{i + 1}"))
        out = step if out is None else out.join(step, f"n{i}")
    return out.select(*[f"n{i}" for i in range(len(edges) + 1)])
