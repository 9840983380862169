"""Point lookups, ordered scans, counters and dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexigrid.functions.text import printable
from lexigrid.functions.timestamps import nanoseconds, seconds
from lexigrid.operators.store import PostingStore
from lexigrid.schema import IDENTITY, STORED


def lookup(postings: DataFrame, mailbox: str, attr: str, term: str, ts: int, id: str) -> DataFrame:  # noqa: A002
    """The posting with this identity, or no row; all conditions reach the scan."""
    return postings.where((F.col("mailbox") == mailbox) & (F.col("attr") == attr) & (F.col("term") == term) & (F.col("ts") == ts) & (F.col("id") == id))


def scan(postings: DataFrame, mailbox: str, attr: str, term: str, start: tuple[int, str] | None = None, skip: int = 0) -> DataFrame:
    """A list's postings by (ts, id), from start on, inclusive, leaving out the first skip."""
    rows = postings.where((F.col("mailbox") == mailbox) & (F.col("attr") == attr) & (F.col("term") == term))
    if start is not None:
        rows = rows.where((F.col("ts") > start[0]) | ((F.col("ts") == start[0]) & (F.col("id") >= start[1])))
    rows = rows.orderBy("ts", "id")
    return rows.offset(skip) if skip else rows


def index_meta(postings: DataFrame) -> DataFrame:
    """(mailbox, attr, term, num_keys, num_bytes): every list's postings and their size without positions."""
    size = F.octet_length("id") + F.coalesce(F.octet_length("bucket"), F.lit(0)) + F.coalesce(F.octet_length("key"), F.lit(0))
    return postings.groupBy("mailbox", "attr", "term").agg(F.count("*").alias("num_keys"), F.sum(size.cast("bigint")).alias("num_bytes"))


def store_meta(store: PostingStore) -> DataFrame:
    """index_meta of a store, with the number of files that hold a list and when the store last changed."""
    commits = store.commits()
    files = store.stored(file=True, commits=commits).groupBy("mailbox", "attr", "term").agg(F.countDistinct(F.xxhash64("file")).alias("num_files"))  # a path's 64 bits stand for it
    last = max(((g["sec"], g["nsec"]) for g in commits), default=(0, 0))
    return index_meta(store.read(commits=commits, columns=[*IDENTITY, "bucket", "key"])).join(files, ["mailbox", "attr", "term"], "left").withColumns({"generation_sec": F.lit(last[0]).cast("bigint"), "generation_nsec": F.lit(last[1]).cast("bigint")})


def pages(store: PostingStore) -> DataFrame:
    """(file, num_keys, first, last): what each file of a store holds."""
    rows = store.stored(file=True).select("file", F.struct("mailbox", "attr", "term", "ts", "id").alias("k"))
    return rows.groupBy("file").agg(F.count("*").alias("num_keys"), F.min("k").alias("first"), F.max("k").alias("last"))


def page_dump(spark: SparkSession, file: str) -> DataFrame:
    """(place, mailbox, attr, term, ts, id, bucket, key, positions, deleted): what one file holds in its order, of a store or a copy of
    a file elsewhere, replaced postings and tombstones included."""
    rows = spark.read.schema(StructType([f for f in STORED.fields if f.name != "shard"])).parquet(file)
    return rows.withColumn("place", F.col("_metadata.row_index")).select("place", *rows.columns).orderBy("place")


def folder_dump(spark: SparkSession, folder: str) -> DataFrame:
    """(file, place, ...): page_dump of every file of a folder, unordered: each file's order is that of place."""
    rows = spark.read.schema(StructType([f for f in STORED.fields if f.name != "shard"])).parquet(folder)
    return rows.withColumns({"file": F.col("_metadata.file_path"), "place": F.col("_metadata.row_index")}).select("file", "place", *rows.columns)


def dump(postings: DataFrame) -> DataFrame:
    """A printable line a posting."""
    return postings.select(F.format_string("id: %s, url: %s:%s, ts: %d.%d, positions: %s", printable(F.col("id")), printable(F.coalesce("bucket", F.lit(""))), printable(F.coalesce("key", F.lit(""))), seconds(F.col("ts")), nanoseconds(F.col("ts")), F.array_join(F.transform("positions", lambda p: p.cast("string")), ",")).alias("line"))
