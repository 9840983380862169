"""Conjunctive search: documents that are on every list asked for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.operators.rank import literal_map
from lexigrid.plans.request import Cookie, Terms


def _among(lists: tuple[tuple[str, str], ...]) -> Column:
    """attr and term as equality and IN, which reach the Parquet scan."""
    by_attr: dict[str, list[str]] = {}
    for attr, term in lists:
        by_attr.setdefault(attr, []).append(term)
    return reduce(lambda a, b: a | b, [(F.col("attr") == a) & F.col("term").isin(ts) for a, ts in by_attr.items()])


def _ordinal(lists: tuple[tuple[str, str], ...]) -> Column:
    table: dict[str, dict[str, int]] = {}
    for i, (attr, term) in enumerate(lists):
        table.setdefault(attr, {})[term] = i
    return F.coalesce(*[F.when(F.col("attr") == attr, literal_map(own, F.col("term"))) for attr, own in table.items()])


def from_cookie(cookie: Cookie | None) -> Column:
    """The keyset condition of a page's start, inclusive."""
    if cookie is None:
        return F.lit(True)
    return (F.col("ts") > cookie.ts) | ((F.col("ts") == cookie.ts) & (F.col("id") >= cookie.id))


def intersect(postings: DataFrame, mailbox: str, terms: Terms, cookie: Cookie | None = None, positions: bool = True) -> DataFrame:
    """(ts, id, bucket, key, indexes): documents that every list of terms holds, unordered.

    An identity that postings hold several times counts once. indexes are the lists' parts in order of request; bucket and key are those of the
    first. No list, or an unknown term, gives no row. One shuffle, on (ts, id), after partial aggregation; filters and the
    columns needed reach the scan. positions False leaves the positions unread.
    """
    if not terms.lists:
        empty = postings.where(F.lit(False))
        ordinal = F.lit(0)
    else:
        empty = postings.where((F.col("mailbox") == mailbox) & _among(terms.lists) & from_cookie(cookie))
        ordinal = _ordinal(terms.lists)
    part = [ordinal.alias("ord"), "attr", "term", *(["positions"] if positions else [])]
    grouped = empty.groupBy("ts", "id").agg(F.min(F.struct(ordinal.alias("ord"), "bucket", "key")).alias("first"), F.array_sort(F.collect_list(F.struct(*part))).alias("indexes"))
    # Sorted by ordinal, so of rows with the same one the first stays.
    once = F.filter("indexes", lambda x, i: (i == 0) | (x["ord"] != F.get("indexes", i - 1)["ord"]))
    return grouped.withColumn("indexes", once).where(F.size("indexes") == len(terms.lists)).select("ts", "id", "first.bucket", "first.key", "indexes")


def count_matches(postings: DataFrame, mailbox: str, terms: Terms) -> DataFrame:
    """(n): how many documents intersect() would give, reading neither positions nor addresses."""
    if not terms.lists:
        return postings.where(F.lit(False)).agg(F.count("*").alias("n"))
    own = postings.where((F.col("mailbox") == mailbox) & _among(terms.lists))
    return own.groupBy("ts", "id").agg(F.size(F.collect_set(_ordinal(terms.lists))).alias("lists")).where(F.col("lists") == len(terms.lists)).agg(F.count("*").alias("n"))


def intersect_by_joins(postings: DataFrame, mailbox: str, terms: Terms) -> DataFrame:
    """(ts, id) by a chain of semi-joins, a shuffle a list: a check of intersect, and better where one list is tiny."""
    lists = [postings.where((F.col("mailbox") == mailbox) & (F.col("attr") == a) & (F.col("term") == t)).select("ts", "id") for a, t in terms.lists]
    if not lists:
        return postings.where(F.lit(False)).select("ts", "id")
    return reduce(lambda a, b: a.join(b, ["ts", "id"], "left_semi"), lists)


def intersect_batch(postings: DataFrame, queries: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(qid, ts, id, bucket, key): many queries (qid, mailbox, attr, term, ord; distinct) answered by one scan.

    The query table is broadcast if it has at most broadcast_rows rows, else joined by shuffle."""
    small = queries.limit(broadcast_rows + 1).count() <= broadcast_rows
    sizes = queries.groupBy("qid").agg(F.count("*").alias("lists"))
    asked = queries.join(sizes, "qid")
    hit = postings.select("mailbox", "attr", "term", "ts", "id", "bucket", "key").join(F.broadcast(asked) if small else asked, ["mailbox", "attr", "term"])
    grouped = hit.groupBy("qid", "ts", "id").agg(F.size(F.collect_set("ord")).alias("n"), F.first("lists").alias("lists"), F.min(F.struct("ord", "bucket", "key")).alias("first"))
    return grouped.where("n = lists").select("qid", "ts", "id", "first.bucket", "first.key")
