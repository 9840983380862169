"""A load of random messages: a vocabulary of random words, so many of them in each message."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions.timestamps import pack
from lexigrid.schema import VALUES

#: Messages that a task makes, and that are passed on at once.
_TASK, _ROWS = 4096, 256
_LETTERS = str.maketrans("0123456789", "ghijklmnop")


def vocabulary_of(seed: int, n: int) -> list[str]:
    """Word k is 5 to 20 letters of a hash of k."""
    return [hashlib.md5(f"{seed}:{k}".encode()).hexdigest().translate(_LETTERS)[: k % 16 + 5] for k in range(n)]


def messages(spark: SparkSession, n: int, words: int = 1000, vocabulary: int = 3000, mailbox: str = "load", seed: int = 1, start: int = 1_700_000_000) -> DataFrame:
    """n messages, the same for the same seed: word k of the vocabulary is 5 to 20 letters of a hash of k, and the words of a
    message are picked by hashes of their places."""
    vocabulary_, places = np.array(vocabulary_of(seed, vocabulary), object), [b"%d" % i for i in range(1, words + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        md5 = hashlib.md5
        for batch in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
            texts = []
            for number in batch.column("number").to_pylist():
                own = b"%d:%d:" % (seed, number)
                hashes = np.frombuffer(b"".join([md5(own + i).digest() for i in places]), ">u4")[::4]  # the first 32 bits of each
                texts.append(" ".join(vocabulary_[hashes % vocabulary]))
            yield pa.RecordBatch.from_arrays([batch.column("number"), pa.array(texts, pa.string())], ["number", "value"])

    tasks = max(1, -(-n // _TASK), min(n, spark.sparkContext.defaultParallelism))
    ids = spark.range(0, n, 1, tasks).withColumnRenamed("id", "number").mapInArrow(run, "number bigint, value string")
    name = F.concat(F.substring(F.md5(F.col("number").cast("string")), 1, 10), F.lit("@"), F.substring(F.sha1(F.col("number").cast("string")), 1, 20))
    return ids.select(F.lit(mailbox).alias("mailbox"), name.alias("id"), F.lit("load").alias("bucket"), name.alias("key"), pack(F.lit(start) + F.col("number"), F.lit(0)).alias("ts"), F.lit("text").alias("attr"), "value").to(VALUES)
