"""The folder that all executors reach, for tables that jobs write and read again."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the folder of setCheckpointDir; a temporary one of this machine only in local mode.

    On a cluster without either it is an error, as each executor would write to its own disk."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        context = spark.sparkContext
        set_ = context._jsc.sc().getCheckpointDir()
        if set_.isDefined():
            where = set_.get()
        elif context.master.split("[")[0] == "local":
            where = "file://" + tempfile.mkdtemp(prefix="lexigrid-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")
