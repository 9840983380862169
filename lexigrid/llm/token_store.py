"""Token ids as raw binary shards, each with a minimal perfect hash index from document key to place."""

from __future__ import annotations

import base64
import json
import struct
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm.common import U64, mix, saved, small_batches
from lexigrid.llm.lookup import place

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of text of a shard, as a mean.
SHARD_BYTES = 16 << 20
#: Distinct pieces whose ids a worker remembers, about 100 bytes each; when full it starts anew.
MEMORY_PIECES = 400_000
#: How byte-level BPE files with ranks alone split text before merging (the public GPT-2 expression).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "shard int, n_docs int, n_tokens bigint, id_bytes int, payload binary, index binary"
_MAGIC = b"LXMPH1\0\0"


class _Pieces(dict):
    """Ids of ' ' + piece, as bytes."""

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMORY_PIECES:
            self.clear()
        ids = self[piece] = self.encode(" " + piece)
        return ids


def _tiktoken(path: str) -> tuple[Callable[[list[str]], list[bytes]], int]:
    import re

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    kind = "<u2" if max(ranks.values()) < 1 << 16 else "<u4"
    encoding = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    one = lambda t: np.array(encoding.encode_ordinary(t), kind).tobytes()
    pieces = _Pieces(one)
    # No piece of SPLIT goes on from a non-blank into a blank. So a text may be cut before a blank that stands alone, and the
    # parts' ids remembered; texts with two blanks in a row or at an end are encoded in one go.
    odd = re.compile(r"\s\s|^\s|\s\Z|[^\S \n]")

    def encode(texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            if not t:
                out.append(b"")
            elif odd.search(t):
                out.append(one(t))
            else:
                head, *rest = t.split(" ")
                out.append(one(head) + b"".join(map(pieces.__getitem__, rest)))
        return out

    return encode, int(kind[2])


def tokenizer(path: str) -> tuple[Callable[[list[str]], list[bytes]], int]:
    """(encode, bytes an id): encode gives little-endian ids. path: a .tiktoken, .json (tokenizers) or .model (sentencepiece) file."""
    if path.endswith(".tiktoken"):
        return _tiktoken(path)
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = "<u2" if sp.vocab_size() <= 1 << 16 else "<u4"
        return lambda texts: [np.array(x, kind).tobytes() for x in sp.encode(texts, num_threads=1)], int(kind[2])
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    kind = "<u2" if t.get_vocab_size() <= 1 << 16 else "<u4"
    return lambda texts: [np.array(x.ids, kind).tobytes() for x in t.encode_batch(texts, add_special_tokens=False)], int(kind[2])


def shard_of(doc_ids: np.ndarray, shards: int) -> np.ndarray:
    return ((mix(np.asarray(doc_ids, np.int64).view(U64)) >> U64(32)) % U64(shards)).astype(np.int32)


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(U64) ^ U64(0xA0761D6478BD642F)) >> U64(32)).astype(np.uint32)


def build_index(keys: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> bytes:
    """keys: distinct 64-bit integers. Levels of bit maps, a key's bit set on the first level where no other key takes it;
    the number of set bits before it is its slot, 0 to len(keys) - 1. Slots hold fingerprint, offset and length."""
    keys = np.asarray(keys, np.int64)
    maps, sizes, slots, before = [], [], np.empty(len(keys), np.int64), 0
    left = np.arange(len(keys))
    while len(left):
        bits = max(3, int(np.ceil(np.log2(len(left) * 1.4))))
        at = place(keys[left], len(sizes), bits)
        taken = np.bincount(at, minlength=1 << bits)
        alone = taken[at] == 1
        one = taken == 1
        slots[left[alone]] = before + (np.cumsum(one) - 1)[at[alone]]
        before += int(one.sum())
        maps.append(np.packbits(one, bitorder="little"))
        sizes.append(bits)
        left = left[~alone]
    order = np.argsort(slots)
    head = json.dumps({"n": len(keys), "levels": sizes}).encode()
    bitmap = np.concatenate([np.zeros(0, np.uint8), *maps])
    ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bitmap), dtype=np.uint32)]).astype("<u4")[:: 8]
    columns = [_fingerprint(keys)[order].astype("<u4"), np.asarray(offsets)[order].astype("<u8"), np.asarray(lengths)[order].astype("<u4")]
    return b"".join([_MAGIC, struct.pack("<III", len(head), len(bitmap), len(ranks)), head, bitmap.tobytes(), ranks.tobytes(), *(c.tobytes() for c in columns)])


class ShardIndex:
    """Reads what build_index wrote, without copying it."""

    def __init__(self, data: bytes) -> None:
        if bytes(data[:8]) != _MAGIC:
            raise ValueError("not an index")
        head, bitmap, ranks = struct.unpack_from("<III", data, 8)
        at = 20
        meta = json.loads(bytes(data[at : at + head]))
        self.n, self.levels = meta["n"], meta["levels"]
        at += head
        self.bitmap = np.frombuffer(data, np.uint8, bitmap, at)
        at += bitmap
        self.ranks = np.frombuffer(data, "<u4", ranks, at)
        at += 4 * ranks
        self.fingerprints = np.frombuffer(data, "<u4", self.n, at)
        self.offsets = np.frombuffer(data, "<u8", self.n, at + 4 * self.n)
        self.lengths = np.frombuffer(data, "<u4", self.n, at + 12 * self.n)

    def slot(self, key: int) -> int:
        """The key's slot, or -1 if the index has no such key; a strange key passes the fingerprint at a rate of 2**-32."""
        k, start = np.array([key], np.int64), 0
        for level, bits in enumerate(self.levels):
            bit = start + int(place(k, level, bits)[0])
            byte = bit >> 3
            if self.bitmap[byte] >> (bit & 7) & 1:
                block = byte >> 3
                own = np.bitwise_count(self.bitmap[block << 3 : byte]).sum(dtype=int) + int(self.bitmap[byte] & ((1 << (bit & 7)) - 1)).bit_count()
                slot = int(self.ranks[block]) + int(own)
                return slot if self.fingerprints[slot] == _fingerprint(k)[0] else -1
            start += 1 << bits
        return -1


class TokenStore:
    """Keyed access to the files of write_store: two reads a document, whatever the size of the store, and one more a shard."""

    def __init__(self, folder: str) -> None:
        self._fs, self._folder = _file_system(folder)
        self.meta = json.loads(self._read("store.json"))
        self._indexes: dict[int, ShardIndex] = {}

    def _read(self, name: str) -> bytes:
        with self._fs.open_input_file(f"{self._folder}/{name}") as f:
            return f.read()

    def __getitem__(self, doc_id: int) -> np.ndarray:
        shard = int(shard_of(np.array([doc_id]), self.meta["shards"])[0])
        if shard not in self._indexes:
            if self._fs.get_file_info(f"{self._folder}/{shard:06d}.idx").type == fs.FileType.NotFound:
                raise KeyError(doc_id)
            self._indexes[shard] = ShardIndex(self._read(f"{shard:06d}.idx"))
        index, size = self._indexes[shard], self.meta["id_bytes"]
        slot = index.slot(doc_id)
        if slot < 0:
            raise KeyError(doc_id)
        with self._fs.open_input_file(f"{self._folder}/{shard:06d}.bin") as f:
            return np.frombuffer(f.read_at(int(index.lengths[slot]) * size, int(index.offsets[slot]) * size), f"<u{size}")


def _once(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of rows with the same doc_id that with the longest text in bytes, of equals that with the greatest hash;
    of rows alike one. Only rows of repeated ids are compared; where none repeats nothing is shuffled but ids."""
    keyed = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    again = saved(keyed.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return keyed
    mark = F.struct(F.coalesce(F.octet_length("text"), F.lit(-1)), F.coalesce(F.xxhash64("text"), F.lit(0)))
    repeated = keyed.join(again, "doc_id").withColumn("mark", mark)
    best = saved(repeated.groupBy("doc_id").agg(F.max("mark").alias("best")), "longest")
    kept = repeated.join(best, "doc_id").where("mark = best").groupBy("doc_id").agg(F.first("text").alias("text"))
    return keyed.join(again, "doc_id", "left_anti").unionByName(kept)


def token_shards(docs: DataFrame, tokenizer_path: str = TOKENIZER, shard_bytes: int = SHARD_BYTES, shards: int | None = None) -> DataFrame:
    """(shard, n_docs, n_tokens, id_bytes, payload, index): the ids of all texts, one row a shard.

    payload is the documents' ids one after the other, little-endian, id_bytes each; index finds a document's offset and
    length in ids (ShardIndex). A document's shard is shard_of(doc_id, number of shards); there are as many shards as the
    texts' bytes ask for, so that texts of any length make shards of alike sizes. Ids are shuffled, texts aren't.

    Nulls: a null doc_id is no key, its row is left out; a null text has no ids, as an empty one, and is found all the same.
    Of rows with the same doc_id the one with the longest text in bytes is kept, of equals that with the greatest hash; so
    repeated rows are stored once. An empty table gives an empty result. Texts are encoded whole; one text's ids must fit the
    2 GB of a binary value. Other columns aren't read.
    """
    small_batches(docs.sparkSession)
    keyed = _once(docs)
    if shards is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(1, -(-size // shard_bytes))

    def encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = tokenizer(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = part.column("doc_id")
                rows = encode([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(shard_of(ids.to_numpy(zero_copy_only=False), shards), pa.int32()), ids, pa.array(rows, pa.binary())], ["shard", "doc_id", "ids"])

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        size = id_bytes(tokenizer_path)
        rows = rows.sort_values("doc_id", kind="stable")
        lengths = rows["ids"].map(len).to_numpy(np.int64) // size
        offsets = np.cumsum(lengths) - lengths
        index = build_index(rows["doc_id"].to_numpy(np.int64), offsets, lengths)
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "n_docs": [len(rows)], "n_tokens": [int(lengths.sum())], "id_bytes": [size], "payload": [b"".join(rows["ids"])], "index": [index]})

    return keyed.mapInArrow(encode_rows, "shard int, doc_id bigint, ids binary").groupBy("shard").applyInPandas(build, SCHEMA)


def token_count(spark: SparkSession, text: Column, tokenizer_path: str = TOKENIZER) -> Column:
    """The number of ids of each text that token_shards stores; 0 for null and empty texts. Texts of any length are encoded whole."""
    small_batches(spark)

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode, id_bytes = tokenizer(tokenizer_path)
        for s in batches:
            yield pd.Series([len(x) // id_bytes for x in encode([t or "" for t in s])], dtype="int64")

    return count.asNondeterministic()(text)  # else a filter on it would encode every text twice


def id_bytes(path: str) -> int:
    if path.endswith(".tiktoken"):  # without building the tables
        return 2 if max(int(line.split()[1]) for line in Path(path).read_bytes().splitlines() if line) < 1 << 16 else 4
    return tokenizer(path)[1]


def _file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """Of a path or a URI of any file system that Arrow knows: file, hdfs, s3, gs."""
    found, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else Path(folder).absolute().as_uri())
    return found, path.rstrip("/")


def write_store(shards: DataFrame, folder: str, number: int, size: int) -> None:
    """The rows of token_shards as <shard>.bin and <shard>.idx in a folder that all executors reach; number of shards and bytes of an
    id. A repeated task writes the same files again; each appears whole, by renaming, and store.json last."""
    _file_system(folder)[0].create_dir(_file_system(folder)[1], recursive=True)

    def write(rows: Iterator) -> None:
        system, at = _file_system(folder)
        for r in rows:
            for name, data in (("bin", r["payload"]), ("idx", r["index"])):
                _put(system, f"{at}/{r['shard']:06d}.{name}", data)

    shards.foreachPartition(write)
    system, at = _file_system(folder)
    _put(system, f"{at}/store.json", json.dumps({"shards": number, "id_bytes": size}).encode())


def _put(system: fs.FileSystem, path: str, data: bytes) -> None:
    folder, name = path.rsplit("/", 1)
    new = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(new) as f:
        f.write(data)
    system.move(new, path)
