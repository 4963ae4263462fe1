"""Tables in parts whose files are named by one manifest: a commit writes new files beside the old ones, then puts a manifest in place by one rename.

A stop at any point leaves the last manifest and all files that it names, so readers stay on whole snapshots of all tables and no row
is lost; a batch that is tried again is committed once, as a manifest tells the last batch of each stream. One writer at a time.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Parts by key that a table is written in, where nothing else is said.
BUCKETS = 32


def bucket_of(key: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("string")


class Store:
    """Tables below path; a table is a set of parts (named by the string column `part`), a part a list of folders."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._jvm, self._fs = jvm, jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")

    def _names(self, folder: str) -> list[str]:
        p = self._hadoop(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("manifests") if re.fullmatch(r"\d+\.json", n)]

    def manifest(self, version: int | None = None) -> dict:
        """version, the last batch by stream, and by table its schema and its folders by part. Without version the newest one."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "batches": {}, "tables": {}}
        stream = self._fs.open(self._hadoop(f"manifests/{version:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def table(self, name: str, manifest: dict | None = None, parts: list[str] | None = None) -> DataFrame | None:
        """A table in the snapshot that a manifest names (the newest), or some of its parts; None if it isn't there."""
        t = (manifest or self.manifest())["tables"].get(name)
        if t is None:
            return None
        schema = StructType.fromJson(t["schema"])
        paths = [f"{self.path}/data/{folder}/part={part}" for part, folders in sorted(t["parts"].items()) if parts is None or part in parts for folder in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, rows: DataFrame) -> tuple[StructType, dict[str, list[str]]]:
        """Writes rows (with the column part) to a new folder that no manifest names yet; what `commit` needs of them."""
        folder = uuid.uuid4().hex
        rows.hint("rebalance", "part").write.partitionBy("part").parquet(f"{self.path}/data/{folder}")
        return rows.drop("part").schema, {n.removeprefix("part="): [folder] for n in self._names(f"data/{folder}") if n.startswith("part=")}

    def commit(self, base: dict, written: dict[str, tuple[StructType, dict[str, list[str]]]], replaced: dict[str, list[str]], stream: str | None = None, batch: int | None = None) -> dict:
        """The next manifest: of each table written the parts replaced are gone, the new ones are added. All tables change in one step."""
        tables = {n: {"schema": t["schema"], "parts": dict(t["parts"])} for n, t in base["tables"].items()}
        for name, (schema, parts) in written.items():
            t = tables.setdefault(name, {"schema": schema.jsonValue(), "parts": {}})
            for p in replaced.get(name, []):
                t["parts"].pop(p, None)
            for p, folders in parts.items():
                t["parts"][p] = t["parts"].get(p, []) + folders
        new = {"version": base["version"] + 1, "batches": base["batches"] | ({stream: batch} if stream is not None else {}), "tables": tables}
        part, final = self._hadoop(f"manifests/.{uuid.uuid4().hex}"), self._hadoop(f"manifests/{new['version']:012d}.json")
        out = self._fs.create(part)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(part, final):
            raise RuntimeError(f"version {new['version']} of {self.path} was committed by another writer")
        return new

    def folded(self, base: dict, name: str, new: DataFrame, key: list[str], fold: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> tuple[tuple, list[str]]:
        """new rows folded with the stored ones of the parts that they touch: fold gets both and returns what stays, part included."""
        n = new.withColumn("part", bucket_of(key, buckets))
        touched = [r[0] for r in n.select("part").distinct().collect()]  # at most buckets
        old = self.table(name, base, touched)
        if old is not None:
            n = old.withColumn("part", bucket_of(key, buckets)).select(*n.columns).unionByName(n)
        return self.write(fold(n)), touched

    def done(self, base: dict, stream: str, batch: int) -> bool:
        return base["batches"].get(stream, -1) >= batch

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes manifests before the last `keep` ones, and folders that none of these names: what old versions and stopped commits left."""
        versions = self.versions()
        for v in versions[:-keep]:
            self._fs.delete(self._hadoop(f"manifests/{v:012d}.json"), False)
        used = {f for v in versions[-keep:] for t in self.manifest(v)["tables"].values() for folders in t["parts"].values() for f in folders}
        gone = [f for f in self._names("data") if f not in used]
        for f in gone:
            self._fs.delete(self._hadoop(f"data/{f}"), True)
        return gone


def latest(key: list[str], order: tuple[str, ...] = ("ts", "event")) -> Callable[[DataFrame], DataFrame]:
    """A fold that keeps each key's last row."""

    def fold(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*key, "part")]
        return rows.groupBy("part", *key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*key, "__r.*", "part")

    return fold


def added(key: list[str]) -> Callable[[DataFrame], DataFrame]:
    """A fold that adds up each key's other columns. A batch must count once, as it does behind the manifest."""

    def fold(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*key, "part")]
        return rows.groupBy("part", *key).agg(*[F.sum(c).alias(c) for c in rest]).select(*key, *rest, "part")

    return fold


def set_and_clear(key: list[str], value: str, order: tuple[str, ...] = ("ts", "event")) -> Callable[[DataFrame], DataFrame]:
    """A fold of sets and clears (column cleared) that come in any order: of each key its last clear stays as a mark, and the sets after it.

    So a late set before a clear stays dead, a late clear finds the sets that it ends, and the first set that stands is known. All
    sets but the last lose their value. A key's rows are never gathered in one row or sorted.
    """

    def fold(rows: DataFrame) -> DataFrame:
        d = rows.withColumn("__at", F.struct(*order))
        ends = d.groupBy("part", *key).agg(F.max(F.when(F.col("cleared"), F.col("__at"))).alias("__clear"), F.max(F.when(~F.col("cleared"), F.col("__at"))).alias("__last"))
        d = d.join(ends, ["part", *key])
        stays = F.coalesce(F.col("__at") >= F.col("__clear"), F.lit(True))  # of clears only the last one does
        d = d.where(stays).withColumn(value, F.when(~F.col("cleared") & (F.col("__at") == F.col("__last")), F.col(value)))
        return d.select(*rows.columns).dropDuplicates([*key, *order, "part"])

    return fold
