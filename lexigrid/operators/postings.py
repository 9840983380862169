"""From attribute values to postings."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrid.functions.text import words
from lexigrid.schema import POSTINGS

Analyzer = Callable[[Column], Column]
#: Words that are grouped at once, at least a value's, and postings that are passed on at once.
_WORDS, _ROWS = 1 << 19, 1 << 16
_OWN = ["mailbox", "attr", "ts", "id", "bucket", "key"]


def tokenize(values: DataFrame, analyzer: Analyzer = words) -> DataFrame:
    """values -> one row a word, with its 0-based position within the attribute's value. No shuffle."""
    return values.select("mailbox", "id", "bucket", "key", "ts", "attr", F.posexplode(analyzer(F.col("value"))).alias("pos", "term")).withColumn("pos", F.col("pos").cast("bigint"))


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about _WORDS words."""
    ends = np.cumsum(batch.column("words").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _WORDS, "right")))
        yield batch.slice(at, end - at)
        at = end


def _order(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the places of its (mailbox, attr) and of the row itself in the order of (mailbox, attr, ts, id)."""
    at = pc.sort_indices(piece, sort_keys=[(c, "ascending") for c in ("mailbox", "attr", "ts", "id")])
    new = np.zeros(len(at), bool)
    for c in ("mailbox", "attr"):
        code = piece.column(c).take(at).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    own, row = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    own[at], row[at] = np.cumsum(new), np.arange(len(at))
    return own, row


def _grouped(shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with an array of words -> a row a distinct word, with its positions in the array. What is grouped at once comes in the
    order of (shard, mailbox, attr, term, ts, id), so that a sort has few runs to merge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for b in batches for p in _pieces(b)):
            lists = piece.column("words")
            terms = lists.flatten()
            if not len(terms):
                continue
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(terms)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            coded = terms.dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            place = np.empty(len(coded.dictionary), np.int64)
            place[pc.sort_indices(coded.dictionary)] = np.arange(len(place))
            shard = np.fromiter((zlib.crc32(t.encode()) % shards for t in coded.dictionary.to_pylist()), np.int64, len(place))
            own, at = _order(piece)
            key = ((shard[code] * len(sizes) + own[row]) * len(place) + place[code]) * len(sizes) + at[row]
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            one = order[first]
            offsets = pa.array(np.append(first, len(order)).astype(np.int32))
            rest = piece.select([c for c in piece.schema.names if c != "words"]).take(pa.array(row[one]))
            columns = dict(zip(rest.schema.names, rest.columns)) | {"term": coded.dictionary.take(pa.array(code[one])), "positions": pa.ListArray.from_arrays(offsets, pa.array(pos[order].astype(np.int64)))}
            names = [*POSTINGS.fieldNames(), *(["ord"] if "ord" in columns else [])]
            out = pa.RecordBatch.from_arrays([columns[n] for n in names], names)
            yield from (out.slice(i, _ROWS) for i in range(0, out.num_rows, _ROWS))

    return run


def postings(values: DataFrame, analyzer: Analyzer = words, shards: int = 1) -> DataFrame:
    """values -> postings: per row and distinct word the ascending positions. No shuffle, as a posting is of one row. shards: of the
    store that they are for, whose order they come in as far as they are made at once.

    A document that comes more than once gives its postings each time; a column ord is passed on, by which the store takes the
    last. Null and empty values, and those without words, give nothing."""
    ordered = [T.StructField("ord", T.LongType())] if "ord" in values.columns else []
    split = values.select(*_OWN, *[f.name for f in ordered], analyzer(F.col("value")).alias("words"))
    return split.mapInArrow(_grouped(shards), T.StructType([*POSTINGS.fields, *ordered]))


def arrived(values: DataFrame) -> DataFrame:
    """values with ord, their places in the batch."""
    return values.withColumn("ord", F.monotonically_increasing_id())


def index_name(mailbox: Column, attr: Column, term: Column) -> Column:
    """A term's printable name; the tables keep the three parts apart, so that dots in them can't be mistaken."""
    return F.concat_ws(".", mailbox, attr, term)


def shard_route(mailbox: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, that a mailbox is routed to: the first 32 bits of its MD5 sum, modulo their number."""
    return F.pmod(F.conv(F.substring(F.md5(mailbox), 1, 8), 16, 10).cast("bigint"), F.lit(shards)).cast("int")
