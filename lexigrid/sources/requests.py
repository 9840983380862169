"""Index requests in JSON: {"mailbox": ..., "docs": [{"id", "bucket", "key", "timestamp": {"tsec", "tnsec"}, "index": {...}}]}."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.functions.timestamps import pack
from lexigrid.functions.variants import get_array, get_int, get_object, get_string, kind
from lexigrid.schema import VALUES


def documents(requests: DataFrame, text: str = "value", now: int | None = None) -> DataFrame:
    """requests, one JSON text a row -> (mailbox, id, bucket, key, ts, index VARIANT), a row a valid document.

    Each element is judged for itself: one that is no object, or lacks a string id, bucket or key, or an object index, is
    left out and the others stay. A missing tsec or tnsec is that of now. Requests that aren't JSON, or lack a string
    mailbox or an array of docs, give nothing. Works on streams too.
    """
    micros = F.unix_micros(F.current_timestamp())  # of the run, of a stream's batch; not of the plan's making
    sec, nsec = (F.floor(micros / 1_000_000), F.pmod(micros, F.lit(1_000_000)) * 1000) if now is None else (F.lit(now), F.lit(0))
    parsed = requests.select(F.try_parse_json(F.col(text)).alias("r"))
    parsed = parsed.select(get_string(F.col("r"), "mailbox").alias("mailbox"), get_array(F.col("r"), "docs").alias("docs")).where("mailbox IS NOT NULL AND docs IS NOT NULL")
    each = parsed.select("mailbox", F.explode(F.try_variant_get("docs", "$", "array<variant>")).alias("d")).where(kind(F.col("d")) == "OBJECT")
    d = F.col("d")
    stamp = F.coalesce(get_object(d, "timestamp"), F.parse_json(F.lit("{}")))
    rows = each.select("mailbox", *[get_string(d, c).alias(c) for c in ("id", "bucket", "key")], pack(F.coalesce(get_int(stamp, "tsec"), sec), F.coalesce(get_int(stamp, "tnsec"), nsec)).alias("ts"), get_object(d, "index").alias("index"))
    return rows.where("id IS NOT NULL AND id != '' AND bucket IS NOT NULL AND key IS NOT NULL AND index IS NOT NULL")


def values(documents: DataFrame) -> DataFrame:
    """documents -> a row an attribute with a string value; others are left out."""
    members = F.explode(F.map_entries(F.try_variant_get("index", "$", "map<string,variant>")))
    rows = documents.select("mailbox", "id", "bucket", "key", "ts", members.alias("m"))
    v = F.col("m.value")
    return rows.where(kind(v) == "STRING").select("mailbox", "id", "bucket", "key", "ts", F.col("m.key").alias("attr"), F.try_variant_get(v, "$", "string").alias("value")).to(VALUES)


def outcome(requests: DataFrame, text: str = "value") -> DataFrame:
    """(mailbox, docs, valid, status): per request how many elements it has and how many are valid, as documents() judges; 400 without any."""
    parsed = requests.select(F.monotonically_increasing_id().alias("n"), F.try_parse_json(F.col(text)).alias("r"))
    parsed = parsed.select("n", get_string(F.col("r"), "mailbox").alias("mailbox"), F.try_variant_get(get_array(F.col("r"), "docs"), "$", "array<variant>").alias("docs"))

    def valid(d):
        return (kind(d) == "OBJECT") & (F.coalesce(get_string(d, "id"), F.lit("")) != "") & get_string(d, "bucket").isNotNull() & get_string(d, "key").isNotNull() & get_object(d, "index").isNotNull()

    good = F.when(F.col("mailbox").isNotNull(), F.size(F.filter("docs", valid)))
    return parsed.select("mailbox", F.greatest(F.size("docs"), F.lit(0)).alias("docs"), F.coalesce(F.greatest(good, F.lit(0)), F.lit(0)).alias("valid")).withColumn("status", F.when(F.col("valid") > 0, 200).otherwise(400))
