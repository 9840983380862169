"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

POSITIONS = T.ArrayType(T.LongType(), False)

#: One value of one attribute of one document; ts is packed (functions.timestamps).
VALUES = T.StructType(
    [
        T.StructField("mailbox", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("bucket", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("ts", T.LongType()),
        T.StructField("attr", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

POSTINGS = T.StructType(
    [
        T.StructField("mailbox", T.StringType()),
        T.StructField("attr", T.StringType()),
        T.StructField("term", T.StringType()),
        T.StructField("ts", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("bucket", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("positions", POSITIONS),
    ]
)

#: How a generation stores them; what orders writes of the same posting is its commit.
STORED = T.StructType([*POSTINGS.fields, T.StructField("deleted", T.BooleanType()), T.StructField("shard", T.IntegerType())])

#: A posting's identity.
IDENTITY = ["mailbox", "attr", "term", "ts", "id"]
