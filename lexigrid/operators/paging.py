"""Pages in the order of (ts, id), resumed by key."""

from __future__ import annotations

import uuid
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.shared import shared_dir

#: Bits of monotonically_increasing_id() that number a partition's rows.
_PLACE = 33


def page(matches: DataFrame, num: int | None) -> DataFrame:
    """The first num rows by (ts, id); all of them for None."""
    ordered = matches.orderBy("ts", "id")
    return ordered if num is None else ordered.limit(num)


def paged(matches: DataFrame, num: int) -> DataFrame:
    """matches with page, the number from 0 of the page of num rows by (ts, id) that each is on: all pages by one sort.

    The sorted rows are written once, so that every later job sees the same places; the driver gets a count a partition."""
    spark = matches.sparkSession
    path = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    matches.orderBy("ts", "id").withColumn("place", F.monotonically_increasing_id()).write.parquet(path)
    rows, part = spark.read.parquet(path), F.shiftright("place", _PLACE)
    sizes = sorted(tuple(r) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = [(p, b) for (p, _), b in zip(sizes, accumulate((n for _, n in sizes), initial=0))]
    offsets = spark.createDataFrame(before, "part bigint, before bigint")
    number = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << _PLACE) - 1))
    return rows.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("page", F.floor(number / num)).drop("part", "before", "place")


def page_info(matches: DataFrame, num: int | None) -> DataFrame:
    """One row (num, completed, start): the page's size, whether nothing follows it, and the cookie of what follows.

    One row more than the page is looked at, so an exactly filled last page is known to be the last."""
    some = page(matches.select("ts", "id"), None if num is None else num + 1)
    if num is None:
        return some.agg(F.count("*").alias("num"), F.lit(True).alias("completed"), F.lit("").alias("start"))
    rank = F.row_number().over(Window.orderBy("ts", "id"))  # over at most num + 1 rows
    after = F.max(F.when(F.col("rank") == num + 1, F.concat_ws(":", F.col("ts").cast("string"), "id")))
    return some.withColumn("rank", rank).agg(F.least(F.count("*"), F.lit(num)).cast("bigint").alias("num"), (F.count("*") <= num).alias("completed"), F.coalesce(after, F.lit("")).alias("start"))


def top_k(ranked: DataFrame, k: int) -> DataFrame:
    """The k most relevant of all matches, which ranking within a page isn't; ties by (ts, id)."""
    return ranked.orderBy(F.desc("relevance"), "ts", "id").limit(k)
