"""Source trees and lists of files as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions.timestamps import pack
from lexigrid.schema import VALUES

SUFFIXES = ("go", "cpp", "hpp", "c", "h", "txt")
MAX_BYTES = 2 << 20


def _values(files: DataFrame, mailbox: str, max_bytes: int, now: int | None) -> DataFrame:
    name = F.regexp_replace("path", "^file:/*", "/")
    rows = files.where(F.col("path").rlike(r"\.(" + "|".join(SUFFIXES) + ")$") & (F.col("length") <= max_bytes))
    text = F.replace(F.replace(F.decode("content", "UTF-8"), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" "))
    sec = F.unix_seconds(F.current_timestamp()) if now is None else F.lit(now)
    return rows.select(F.lit(mailbox).alias("mailbox"), name.alias("id"), F.lit("unused").alias("bucket"), F.lit("unused").alias("key"), pack(sec, F.lit(1234)).alias("ts"), F.lit("text").alias("attr"), text.alias("value")).to(VALUES)


def crawl(spark: SparkSession, folder: str, mailbox: str = "files", max_bytes: int = MAX_BYTES, now: int | None = None) -> DataFrame:
    """Every source or text file below folder as a document; larger files are left out before they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return _values(files, mailbox, max_bytes, now)


def listed(spark: SparkSession, list_file: str, mailbox: str = "files", max_bytes: int = MAX_BYTES, now: int | None = None) -> DataFrame:
    """The files named by the lines of list_file; names that don't exist are left out. The folders they lie in are listed, once
    each, and only files that are named are read."""
    names = spark.read.text(list_file).select(F.trim("value").alias("name")).where("name != ''").select(F.regexp_replace("name", "^file:/*", "/").alias("name")).distinct()
    folders = [r[0] for r in names.select(F.regexp_extract("name", "^(.*)/", 1)).distinct().collect()]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = [f or "/" for f in folders if (p := hadoop(f or "/")).getFileSystem(conf).exists(p)]
    if not there:
        return spark.createDataFrame([], VALUES)
    files = spark.read.format("binaryFile").load(there)
    wanted = files.select("path", "length").join(names, F.regexp_replace("path", "^file:/*", "/") == F.col("name"), "left_semi").select("path")
    return _values(files.join(wanted, "path", "left_semi"), mailbox, max_bytes, now)
