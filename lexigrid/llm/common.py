"""What the operators of this package share: shared folder, row packing, and hashing in numpy."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.shared import shared_dir

U64 = np.uint64
#: Bytes of text that a Python worker holds as arrays at once; longer texts are taken alone, whole.
CHUNK_BYTES = 512 << 10
#: Partitions of a shuffle whose groups are long work and few bytes, where merging small partitions would queue them up.
MAX_PARTITIONS = 20_000
#: A run of non-blank characters that is longer counts as several words where words are bounded.
WORD_CHARS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage and survives lost executors.

    The files go when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Let Python workers take texts in batches of at most 4 MB and 2,000 rows, unless the session has less: texts are long,
    and a worker holds several batches in several forms. The session keeps the setting, as plans read it when they run."""
    for name, most in (("maxBytesPerBatch", 4 << 20), ("maxRecordsPerBatch", 2000)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key)
        size = int(now.rstrip("bB")) if now.rstrip("bB").lstrip("-").isdigit() else -1
        if size <= 0 or size > most:
            spark.conf.set(key, str(most))


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """docs as one struct column `row_`, beside columns of the operator's own; so no name of docs can clash with them."""
    return docs.select(F.struct("*").alias("row_"), *(c.alias(k) for k, c in columns.items()))


def unpacked(df: DataFrame, *more: Column) -> DataFrame:
    return df.select("row_.*", *more)


def word_count(text: Column) -> Column:
    """Runs of non-blank characters; 0 for null and blank texts."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def bounded_word_count(text: Column) -> Column:
    """Words of at most WORD_CHARS characters, longer runs being cut; so a text without blanks has tokens by its length."""
    return F.coalesce(F.regexp_count(text, F.lit(rf"\S{{1,{WORD_CHARS}}}")), F.lit(0)).cast("bigint")


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    h = np.asarray(h, dtype=U64)
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class Powers:
    """B**i and B**-i modulo 2**64, extended as needed: a prefix sum of x[j] * B**-j gives the hash of any span."""

    B = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=U64)
        self.down = np.ones(1, dtype=U64)

    def __getstate__(self) -> dict:
        return {"up": np.ones(1, dtype=U64), "down": np.ones(1, dtype=U64)}  # workers grow their own

    def grow(self, n: int) -> None:
        if n <= len(self.up):
            return
        n = max(n, 1 << 16)
        for name, base in (("up", self.B), ("down", pow(self.B, -1, 1 << 64))):
            x = np.full(n, base, dtype=U64)
            x[0] = 1
            setattr(self, name, np.multiply.accumulate(x))

    def spans(self, x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of x[start:end] for each pair; it depends on the content alone."""
        self.grow(len(x) + 1)
        prefix = np.zeros(len(x) + 1, dtype=U64)
        np.cumsum((x.astype(U64) + U64(1)) * self.down[: len(x)], out=prefix[1:])
        return mix((prefix[end] - prefix[start]) * self.up[start])


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES):
    """Yield (first, last) of runs of texts with at most `limit` bytes together, or one longer text."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)
