"""Statistics of storage backends, from their monitors' JSON: {"backends": {"<n>": {"backend": ..., "status": ...}}}."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BACKEND = """struct<backend_id:bigint,
  backend:struct<config:struct<`group`:bigint,blob_size_limit:bigint,blob_flags:bigint>,
                 summary_stats:struct<records_total:bigint,records_removed:bigint,records_corrupted:bigint,base_size:bigint,records_removed_size:bigint>,
                 vfs:struct<bfree:bigint,blocks:bigint,bsize:bigint,frsize:bigint>>,
  status:struct<state:bigint,read_only:boolean,last_start_err:bigint,defrag_state:bigint>>"""
_NO_SIZE_CHECK = 1 << 4

#: Free shares below which a backend shouldn't, and mustn't, be written.
SOFT, HARD = 0.2, 0.1


def backends(monitors: DataFrame, text: str = "value") -> DataFrame:
    """monitors, one JSON text a row -> a row a backend with its group, state, sizes and records.

    Backends without config, summary or file system figures, with a negative group, with no room, or with more removed
    records than there are, are left out. Without a size limit, or with the flag against checking it, the file system's size
    is the limit. level tells whether free room is below the soft or the hard share."""
    each = monitors.select(F.explode(F.from_json(F.col(text), f"struct<backends:map<string,{_BACKEND}>>")["backends"]).alias("name", "b"))
    b = lambda path: F.col(f"b.{path}")
    number = lambda path: F.coalesce(b(path), F.lit(0))
    each = each.where(b("backend.config").isNotNull() & b("backend.summary_stats").isNotNull() & b("backend.vfs").isNotNull())
    total = number("backend.vfs.frsize") * number("backend.vfs.blocks")
    limit = number("backend.config.blob_size_limit")
    unchecked = (limit == 0) | (number("backend.config.blob_flags").bitwiseAND(F.lit(_NO_SIZE_CHECK)) != 0)
    rows = each.select(
        F.coalesce(b("backend_id"), F.expr("try_cast(name AS bigint)")).alias("backend_id"),
        b("backend.config.group").alias("group"),
        F.coalesce(b("status.state"), F.lit(0)).alias("state"),
        F.coalesce(b("status.read_only"), F.lit(True)).alias("ro"),
        number("status.last_start_err").alias("start_error"),
        number("status.defrag_state").alias("defrag_state"),
        F.when(unchecked, total).otherwise(limit).alias("size_limit"),
        number("backend.summary_stats.base_size").alias("used"),
        number("backend.summary_stats.records_removed_size").alias("removed"),
        number("backend.summary_stats.records_total").alias("records_total"),
        number("backend.summary_stats.records_removed").alias("records_removed"),
        number("backend.summary_stats.records_corrupted").alias("records_corrupted"),
        (number("backend.vfs.bfree") * number("backend.vfs.bsize")).alias("vfs_avail"),
        total.alias("vfs_total"),
    ).where("`group` >= 0 AND size_limit > used AND records_total >= records_removed")
    free = (F.col("size_limit") - F.col("used")) / F.col("size_limit")
    return rows.withColumn("level", F.when(free < HARD, "hard").when(free < SOFT, "soft").otherwise("ok"))


def by_group(stats: DataFrame) -> DataFrame:
    """Sizes and records of each group."""
    return stats.groupBy("group").agg(*[F.sum(c).alias(c) for c in ("size_limit", "used", "removed", "records_total", "records_removed", "records_corrupted")], F.count("*").alias("backends"))
