"""The folder for checkpoints: the session's, or one of our own where none is set and all runs in one process."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def ensure(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        own = spark.conf.get("spark.checkpoint.dir", None)
        if not own and not (sc.master or "").startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: executors would write where no other one reads")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()
