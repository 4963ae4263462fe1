"""What the corpus operators share: scratch tables, text splitting, counters packed into longs."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of anything but these.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir or, where it is unset and all runs in one process, one of our own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        own = spark.conf.get("spark.checkpoint.dir", None)
        if not own and not (sc.master or "").startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: executors would write where no other one reads")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage in a form that lost executors don't take away."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; lower() does that on ASCII texts, translate() is the slower way for the others."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(c), SPACE), "")


def shingles(w: Column, k: int) -> Column:
    """Array of structs s0..s(k-1) of neighbouring words; one of all words where there are fewer than k; empty for none."""
    n = F.size(w)
    runs = F.arrays_zip(*[F.slice(w, i + 1, n - (k - 1)).alias(f"s{i}") for i in range(k)])
    few = F.array(F.struct(*[F.get(w, F.lit(i)).alias(f"s{i}") for i in range(k)]))
    return F.when(n >= k, runs).when(n > 0, few).otherwise(F.array().cast(few_type(k)))


def few_type(k: int) -> str:
    return "array<struct<" + ",".join(f"s{i}:string" for i in range(k)) + ">>"


def bit_votes(h: str, weight: Column | None = None, prefix: str = "v") -> list[Column]:
    """Sums that count, for each of the 64 bits of column h, the weight of the rows that set it: two counters of 32 bits in each of 32 longs."""
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    return [F.sum(F.shiftrightunsigned(F.col(h), i).bitwiseAND(F.lit(0x0000000100000001)) * w).alias(f"{prefix}{i}") for i in range(32)]


def majority(total: str, prefix: str = "v") -> Column:
    """The 64 bits whose votes make up over half of column total."""
    bits = []
    for b in range(64):
        v = F.col(f"{prefix}{b % 32}")
        votes = F.shiftrightunsigned(v, 32) if b >= 32 else v.bitwiseAND(F.lit(0xFFFFFFFF))
        one = F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b).cast("long")
        bits.append(F.when(votes * 2 > F.col(total), one).otherwise(F.lit(0).cast("long")))
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def hex16(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")
