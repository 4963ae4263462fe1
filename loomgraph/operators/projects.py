"""Detection of project roots from listings, and keeping a project table in step with it."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scalars import basename, repo_name, stem
from loomgraph.operators.validation import CONTEXT_SCOPES, PROVIDERS, STATES

HEX_COLOR = re.compile(r"#(?:[0-9a-fA-F]{3}|[0-9a-fA-F]{6})")

#: Fixed values: (signal, file or directory name, kind of match, confidence), best first.
SIGNALS = [
    ("explicit", ".project", "any", 100),
    ("git", ".git", "any", 90),
    ("cargo", "Cargo.toml", "file", 80),
    ("npm", "package.json", "file", 80),
    ("python", "pyproject.toml", "file", 80),
    ("go", "go.mod", "file", 80),
    ("dotnet", ".sln", "suffix", 80),
    ("maven", "pom.xml", "file", 80),
    ("gradle", "build.gradle", "prefix", 70),
    ("idea", ".idea", "dir", 70),
    ("vscode", ".vscode", "dir", 60),
    ("make", "Makefile", "make", 50),
]
#: Signals that need a name read from their content, directories that hold no projects.
NAMED = ("cargo", "npm", "python", "go", "dotnet", "maven")
JUNK = ["node_modules", "target", "vendor", "__pycache__", ".cache"]


def signal_of(name: Column, is_dir: Column) -> Column:
    """Position in SIGNALS of the signal that a name gives, else null."""
    out = F.lit(None).cast("int")
    for i, (_, text, kind, _) in reversed(list(enumerate(SIGNALS))):
        hit = {
            "any": name == text, "file": ~is_dir & (name == text), "dir": is_dir & (name == text), "suffix": ~is_dir & name.endswith(text) & (F.length(name) > len(text)),
            "prefix": ~is_dir & name.isin(text, f"{text}.kts"), "make": ~is_dir & name.isin(text, text.lower()),
        }[kind]
        out = F.when(hit, F.lit(i)).otherwise(out)
    return out


def toml_name(content: pd.Series, signal: pd.Series) -> pd.Series:
    """Package or project name of TOML contents; none if they can't be read, or if a project's own configuration breaks its rules."""

    def one(text: str | None, kind: str) -> str | None:
        try:
            d = tomllib.loads(text or "")
        except tomllib.TOMLDecodeError:
            return None
        table = lambda *path: reduce(lambda x, k: x.get(k) if isinstance(x, dict) else None, path, d)
        if kind == "explicit":
            found = table("project", "name")
            color = table("appearance", "accent_color")
            good = isinstance(found, str) and found.strip() and (table("project", "status") or "active") in STATES and (color is None or HEX_COLOR.fullmatch(str(color)))
            good = good and (table("tracker") is None or table("tracker", "provider") in PROVIDERS) and (table("ai", "context_scope") or "project") in CONTEXT_SCOPES
            return found if good else None
        found = table("package", "name") if kind == "cargo" else table("project", "name") or table("tool", "poetry", "name")
        return found if isinstance(found, str) else None

    return pd.Series([one(t, s) for t, s in zip(content, signal, strict=True)], dtype="object")


def with_names(found: DataFrame) -> DataFrame:
    """found (dir, file, signal, content, ...) with name: from the content or the file's name where the signal has one, else the directory's."""
    c = F.col("content")
    is_ = lambda x: F.col("signal") == x
    read = F.when(is_("npm"), F.get_json_object(c, "$.name")).when(is_("go"), F.regexp_extract(F.trim(F.regexp_extract(c, r"\Amodule ([^\r\n]*)", 1)), r"([^/]+)$", 1))
    read = read.when(is_("maven"), F.trim(F.regexp_extract(c, r"(?s)<project[^>]*>.*?<artifactId>([^<]+)</artifactId>", 1))).when(is_("dotnet"), stem(F.col("file")))
    plain = found.where("signal not in ('cargo', 'python', 'explicit')").withColumn("read", read.when(is_("git"), repo_name(F.regexp_extract(c, r"url\s*=\s*(\S+)", 1))))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(read=toml_name(b["content"], b["signal"]))

    toml = found.where("signal in ('cargo', 'python', 'explicit')")
    toml = toml.mapInPandas(read, found.schema.add("read", "string") if "read" not in found.columns else found.schema)
    both = plain.unionByName(toml)
    name = F.when(F.coalesce("read", F.lit("")) != "", F.col("read"))
    return both.withColumn("readable", name.isNotNull()).withColumn("name", F.coalesce(name, basename(F.col("dir")))).drop("read")


def detect(listing: DataFrame, max_depth: int = 3, root: str = "") -> DataFrame:
    """(root_path, signal, confidence, name) of project roots in listing (path, is_dir, content).

    Of a directory's signals the best counts; signals that name a project need a readable name. Hidden and junk directories and what
    lies deeper than max_depth below root are left out, and so are roots below another root.
    """
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    d = listing.select("path", "is_dir", "content", name.alias("file"), F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("dir"))
    d = d.withColumn("i", signal_of(F.col("file"), F.col("is_dir"))).where("i is not null")
    parts = F.array_remove(F.split(F.expr(f"substring(dir, {len(root) + 1})"), "/"), "")
    d = d.where((F.size(parts) <= max_depth) & ~F.exists(parts, lambda p: p.startswith(".") | p.isin(JUNK)))
    table = F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(c).alias("confidence")) for s, _, _, c in SIGNALS])
    d = with_names(d.withColumn("s", F.get(table, F.col("i"))).select("dir", "file", "i", "s.*", "content"))
    d = d.where(F.col("readable") | ~F.col("signal").isin(*NAMED))
    best = d.groupBy("dir").agg(F.min_by(F.struct("signal", "confidence", "name"), F.struct("i", "file")).alias("b")).select(F.col("dir").alias("root_path"), "b.*")
    return outermost(best)


def outermost(roots: DataFrame) -> DataFrame:
    """Roots that don't lie below another one."""
    parts = F.split("root_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    d = roots.where(F.size(parts) > 1).select("root_path", F.explode(above).alias("above"))
    inner = d.join(roots.select(F.col("root_path").alias("above")), "above", "left_semi").select("root_path").distinct()
    return roots.join(inner, "root_path", "left_anti")


def reconcile(stored: DataFrame, found: DataFrame) -> DataFrame:
    """(root_path, transition, name, inferred, promoted, confidence, status) of stored projects (root_path, name, inferred, promoted, confidence, status) against what is found now."""
    s = stored.select("root_path", F.struct("name", "inferred", "promoted", "confidence", "status").alias("s"))
    f = found.select("root_path", F.struct("signal", "name", "confidence").alias("f"))
    d = s.join(f, "root_path", "full_outer")
    explicit = F.col("f.signal") == "explicit"
    change = (
        F.when(F.col("s").isNull(), "insert")
        .when(F.col("f").isNull(), F.when(F.col("s.status") == "archived", "keep").when(F.col("s.inferred"), "keep").otherwise("archive"))
        .when(explicit, "update")
        .when(~F.col("s.inferred"), "demote")
        .otherwise("keep")
    )
    d = d.withColumn("transition", change)
    t = F.col("transition")
    return d.select(
        "root_path", "transition",
        F.when(t.isin("insert", "update"), F.col("f.name")).otherwise(F.col("s.name")).alias("name"),
        F.when(t.isin("insert", "update"), ~explicit).when(t == "demote", True).otherwise(F.col("s.inferred")).alias("inferred"),
        F.when(t.isin("insert", "update"), explicit | F.coalesce("s.promoted", F.lit(False))).when(t == "demote", False).otherwise(F.col("s.promoted")).alias("promoted"),
        F.when(t.isin("insert", "update", "demote"), F.col("f.confidence")).otherwise(F.col("s.confidence")).alias("confidence"),
        F.when(t == "archive", "archived").when(t.isin("insert", "update"), "active").otherwise(F.col("s.status")).alias("status"),
    )


def create_projects(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming projects that may be created: root_path is new, and first in the batch by id."""
    first = incoming.groupBy("root_path").agg(F.min_by(F.struct(*[c for c in incoming.columns if c != "root_path"]), "id").alias("r")).select("root_path", "r.*")
    return first.join(existing.select("root_path"), "root_path", "left_anti")


def prune(projects: DataFrame, directories: DataFrame) -> DataFrame:
    """projects with outcome: alive, deleted (root gone, inferred) or archived (root gone, explicit)."""
    d = projects.join(directories.select(F.col("path").alias("root_path")).distinct().withColumn("__there", F.lit(True)), "root_path", "left")
    return d.withColumn("outcome", F.when(F.col("__there"), "alive").when(F.col("inferred"), "deleted").otherwise("archived")).drop("__there")


FIXED = ("root_path", "created_at", "archived_at", "last_accessed")


def change_projects(projects: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """projects after changes (id, action, any columns to set): update (never a FIXED column), archive, promote, touch, delete.

    One change of each id and action; actions on one id add up, a delete takes the row out.
    """
    done = changes.groupBy("id").agg(*[F.max(F.col("action") == a).alias(f"__{a}") for a in ("update", "archive", "promote", "touch", "delete")], *[F.max(F.when(F.col("action") == "update", F.col(c))).alias(f"__new_{c}") for c in changes.columns if c in projects.columns and c not in ("id", *FIXED)])
    d = projects.join(done, "id", "left").where(~F.coalesce("__delete", F.lit(False)))
    hit = lambda a: F.coalesce(f"__{a}", F.lit(False))
    d = d.withColumns({c.removeprefix("__new_"): F.when(hit("update"), F.coalesce(c, c.removeprefix("__new_"))).otherwise(F.col(c.removeprefix("__new_"))) for c in done.columns if c.startswith("__new_")})
    d = d.withColumns({"status": F.when(hit("archive"), "archived").otherwise(F.col("status")), "archived_at": F.when(hit("archive"), now).otherwise(F.col("archived_at")), "promoted": F.col("promoted") | hit("promote"), "last_accessed": F.when(hit("touch"), now).otherwise(F.col("last_accessed"))})
    return d.select(*projects.columns)


def unlink_files(part_of: DataFrame, project_ids: DataFrame) -> DataFrame:
    """FILE_PART_OF edges without those of some projects."""
    return part_of.join(project_ids.select(F.col("id").alias("dst_id")).distinct(), "dst_id", "left_anti").select("src_id", "dst_id")


def active_projects(projects: DataFrame, promoted: bool = False) -> DataFrame:
    """Projects in use; with promoted, only those that are shown."""
    d = projects.where(F.col("status") == "active")
    return d.where("promoted") if promoted else d


def lookup(projects: DataFrame, keys: DataFrame, by: str = "id") -> DataFrame:
    """Projects by id or root_path, for a table of keys at once."""
    return projects.join(keys.select(by).distinct(), by, "left_semi")
