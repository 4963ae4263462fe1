"""Column expressions: migration transforms, path, name, time and type helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"(?U)^\s+|\s+$"


def trim_unicode(c: Column) -> Column:
    """trim() takes spaces only; this takes all Unicode white space."""
    return F.regexp_replace(c, WHITE, "")


def uuid5(namespace: uuid.UUID, *parts: Column) -> Column:
    """Name-based id of the parts joined by the unit separator; nulls count as empty."""
    name = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


# Transforms that a migration names. Input that a transform can't take becomes null, so that the caller can set the row aside.


def split_comma(c: Column) -> Column:
    return F.coalesce(F.transform(F.split(c, ","), trim_unicode), F.array().cast("array<string>"))


def split_newline(c: Column) -> Column:
    body = F.regexp_replace(c, r"\r?\n\z", "")
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n"))


def _join(sep: str) -> Callable[[Column], Column]:
    return lambda c: F.when(c.isNull(), "").when(F.forall(c, lambda x: x.isNotNull()), F.array_join(c, sep))


def parse_int(c: Column) -> Column:
    return F.when(c.isNull(), F.lit(0).cast("bigint")).otherwise(trim_unicode(c.cast("string")).try_cast("bigint"))


def parse_float(c: Column) -> Column:
    t = trim_unicode(c.cast("string"))
    number = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
    return F.when(c.isNull(), F.lit(0.0)).otherwise(F.when(F.abs(number) < float("inf"), number))


def epoch_to_datetime(c: Column) -> Column:
    return F.date_format(F.timestamp_seconds(c.cast("bigint")), "yyyy-MM-dd'T'HH:mm:ssxxx")


def datetime_to_epoch(c: Column) -> Column:
    return F.when(c.rlike(r"(Z|z|[+-]\d\d:\d\d)$"), F.unix_seconds(F.try_to_timestamp(c)))


TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "split_comma": split_comma,
    "split_newline": split_newline,
    "join_comma": _join(", "),
    "join_newline": _join("\n"),
    "to_string": lambda c: F.coalesce(c.cast("string"), F.lit("")),
    "parse_int": parse_int,
    "parse_float": parse_float,
    "to_lowercase": F.lower,
    "to_uppercase": F.upper,
    "trim": trim_unicode,
    "epoch_to_datetime": epoch_to_datetime,
    "datetime_to_epoch": datetime_to_epoch,
    "nullify": lambda c: F.lit(None).cast("string"),
    "default_empty_string": lambda c: F.lit(""),
    "default_zero": lambda c: F.lit(0).cast("bigint"),
    "default_false": lambda c: F.lit(False),
    "default_empty_array": lambda c: F.array().cast("array<string>"),
}


def apply_transform(name: str, c: Column) -> Column:
    """The named transform of c; an unknown name is a KeyError while the plan is made. TRANSFORMS takes more entries."""
    return TRANSFORMS[name](c)


# Names and paths


def normalize_name(c: Column) -> Column:
    return trim_unicode(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def string_similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0.95 if equal but for case, else the Jaccard likeness of the sets of lower-case characters."""
    x, y = F.array_distinct(F.split(F.lower(a), "")), F.array_distinct(F.split(F.lower(b), ""))
    x, y = F.array_remove(x, ""), F.array_remove(y, "")
    both = F.size(F.array_union(x, y))
    return F.when(a == b, F.lit(1.0)).when(F.lower(a) == F.lower(b), F.lit(0.95)).otherwise(F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / both))


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*)$", 1)


def extension(c: Column) -> Column:
    """With its dot; empty for names that only begin with a dot or have none."""
    return F.regexp_extract(basename(c), r"^.+(\.[^.]*)$", 1)


def stem(c: Column) -> Column:
    return F.when(extension(c) == "", basename(c)).otherwise(F.regexp_extract(basename(c), r"^(.+)\.[^.]*$", 1))


def last_components(c: Column, n: int) -> Column:
    """The last n of what slashes part, empty names included; slashes at the end don't count."""
    parts = F.split(F.regexp_replace(c, "/+$", ""), "/")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - (n - 1), F.lit(1)), F.lit(n)), "/")


def sanitize_dirname(c: Column) -> Column:
    clean = F.regexp_replace(c, r"[^A-Za-z0-9\-_.]", "-")
    return F.coalesce(F.when(clean != "", clean), F.lit("unnamed"))


def repo_name(url: Column) -> Column:
    name = F.regexp_extract(F.regexp_replace(url, r"\.git$", ""), r"([^/:]+)$", 1)
    return F.when(name != "", name)


def common_directory(lo: Column, hi: Column, n: Column) -> Column:
    """Directory shared by the smallest and the largest of n paths, so by all of them; the parent of a single one."""
    top = F.least(F.length(lo), F.length(hi))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(top, F.lit(1))), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (i <= top) & (F.substring(lo, i, F.lit(1)) == F.substring(hi, i, F.lit(1))), i).otherwise(acc))
    shared = F.when(n == 1, lo).otherwise(F.substring(lo, F.lit(1), same))
    return F.regexp_extract(shared, r"^(.*)/", 1)


# Times: events count microseconds, projects milliseconds (0: none)


def micros_to_date(c: Column) -> Column:
    return F.date_format(F.timestamp_micros(c), "yyyy-MM-dd")


def day_range(date: Column) -> tuple[Column, Column]:
    start = F.unix_micros(F.to_timestamp(date.try_cast("date")))
    return start, start + 86_400_000_000


def millis_to_timestamp(c: Column) -> Column:
    return F.timestamp_millis(F.nullif(c, F.lit(0)))


def timestamp_to_millis(c: Column) -> Column:
    return F.coalesce(F.unix_millis(c), F.lit(0))


def project_status(c: Column) -> Column:
    return F.when(c == "archived", "archived").otherwise("active")


# Types and declarations


def split_type(c: Column) -> tuple[Column, Column]:
    """Namespace and name of a dotted type; nulls if a side is empty."""
    ns, name = (F.regexp_extract(c, r"^(.+)\.([^.]+)$", i) for i in (1, 2))
    return F.when(ns != "", ns), F.when(ns != "", name)


def is_pascal_case(c: Column) -> Column:
    return c.rlike(r"^\p{Lu}[\p{L}\p{N}]*$")


def is_snake_case(c: Column) -> Column:
    return c.rlike(r"^[\p{Ll}0-9][\p{Ll}0-9_]*$")


def is_hex_color(c: Column) -> Column:
    return c.rlike(r"^#([0-9A-Fa-f]{3}|[0-9A-Fa-f]{6})$")


def json_kind(v: Column) -> Column:
    """Name of a VARIANT's kind."""
    s = F.schema_of_variant(v)
    return F.when(v.isNull() | (s == "VOID"), "null").when(s == "BOOLEAN", "boolean").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").when(s == "STRING", "string").otherwise("number")


def migration_versions(file: Column) -> tuple[Column, Column]:
    return tuple(F.regexp_extract(file, r"^(.+?)_to_(.+)\.toml$", i) for i in (1, 2))  # type: ignore[return-value]


def app_of_executable(path: Column, product: str, development: bool = False) -> Column:
    """An app id from an executable's path, null for unknown ones. Of the product's installations the system's go first, then the user's, its AI daemon, its other daemons, and builds from source."""
    after = lambda marker: F.split_part(F.substring_index(F.substr(path, F.instr(path, marker) + len(marker)), "/", 1), F.lit("/"), F.lit(1))
    system, user = f"/usr/lib/{product}/apps/", f"/.local/share/{product}/apps/"
    out = F.when(path.startswith(system) & (after(system) != ""), after(system)).when(path.contains(user) & (after(user) != ""), after(user))
    out = out.when(path.endswith(f"/{product}-ai-daemon") | path.endswith(f"/{product}-ai"), "ai-daemon").when(path.startswith(f"/usr/bin/{product}-"), "system")
    if development:
        out = out.when(path.contains("/target/debug/") | path.contains("/target/release/"), F.concat(F.lit("dev."), basename(path)))
    return out
