"""Postings on a file system: append-only generations, last write wins, tombstones, compaction.

Layout under a table's path: data/<uuid>/shard=<s>/*.parquet and commits/<n>.json. A writer fills a folder of its own and then
creates the next commit file, which names the folder; readers open only folders that commits name. So readers see all of a
batch or nothing, a writer that dies leaves a folder that nobody reads, and of two writers at once each gets a number of its
own: file systems create a file that doesn't exist for one of them only, and the other takes the next number. A commit file
that its writer didn't finish counts as none. A commit may replace earlier generations (compaction); their files stay until
vacuum(), as readers may still use them.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrid.config import EngineConfig
from lexigrid.schema import IDENTITY, POSTINGS, STORED
from lexigrid.shared import shared_dir

#: What orders writes of a posting when rows are read: the generation, or of a compacted one the last that it replaced.
SEQ = T.StructField("seq", T.LongType())


def shard_of(term: str, shards: int) -> int:
    """The same on the driver as shard_column in a plan; so a query's terms name the directories to read."""
    return zlib.crc32(term.encode()) % shards


def shard_column(term: Column, shards: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(shards)).cast("int")


class Conflict(RuntimeError):
    """Another writer replaced what this one read."""


class PostingStore:
    def __init__(self, spark: SparkSession, path: str, config: EngineConfig | None = None) -> None:
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or EngineConfig()
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- commits ------

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            reader = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
            return reader.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _commit_numbers(self) -> list[int]:
        folder = self._path(f"{self.path}/commits")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def commits(self) -> list[dict]:
        """All finished commits by generation."""
        out = []
        for n in self._commit_numbers():
            try:
                out.append(json.loads(self._read(f"{self.path}/commits/{n:012d}.json")))
            except ValueError:  # its writer is still at it, or died
                continue
        return out

    def generations(self, commits: list[dict] | None = None) -> list[dict]:
        """The commits in force: those that no later one replaces."""
        all_ = self.commits() if commits is None else commits
        gone = {g for c in all_ for g in c["replaces"]}
        return [c for c in all_ if c["gen"] not in gone]

    def exists(self) -> bool:
        return bool(self.commits())

    def _commit(self, folder: str, kind: str, replaces: list[int], shards: int, tag: str | None) -> dict:
        self._fs.mkdirs(self._path(f"{self.path}/commits"))
        while True:
            in_force = {c["gen"] for c in self.generations()}
            if not in_force.issuperset(replaces):
                raise Conflict(f"{sorted(set(replaces) - in_force)} were replaced by another writer")
            gen, now = max(self._commit_numbers(), default=0) + 1, time.time_ns()
            commit = {"gen": gen, "seq": max(replaces, default=gen), "kind": kind, "replaces": replaces, "folder": folder, "sec": now // 10**9, "nsec": now % 10**9, "shards": shards, "tag": tag}
            try:
                out = self._fs.create(self._path(f"{self.path}/commits/{gen:012d}.json"), False)
            except Exception:
                if gen in self._commit_numbers():  # another writer was first
                    continue
                raise
            out.write(json.dumps(commit).encode())
            out.close()
            return commit

    def _shards(self, commits: list[dict]) -> int:
        return commits[0]["shards"] if commits else self.config.shards

    def shards(self) -> int:
        return self._shards(self.commits())

    def _write(self, rows: DataFrame, kind: str, replaces: list[int], commits: list[dict], tag: str | None = None, spread: bool = True) -> dict:
        """rows: postings with deleted, each identity once.

        One shuffle, in which a frequent term's postings are many tasks' work: by shard and a hash of the document, or for a
        compacted generation by ranges of the identity, so that a term's postings stand in few files. Ranges are sampled from
        the rows first, which for new rows would split all texts into words twice. spread False: none, if the rows' tasks are even
        as they are; each sorts its own and has a file of each shard."""
        if self.config.read_only:
            raise PermissionError(f"{self.path} was opened for reading")
        shards, key = self._shards(commits), ["shard", *IDENTITY]
        rows = rows.withColumn("shard", shard_column(F.col("term"), shards)).select(*STORED.fieldNames())
        if spread and kind == "compact":
            rows = rows.repartitionByRange(*key)
        elif spread:
            parts = -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // shards)
            rows = rows.repartition("shard", F.pmod(F.hash("mailbox", "ts", "id"), F.lit(parts)))
        folder = uuid.uuid4().hex
        rows.sortWithinPartitions(*key).write.option("compression", self.config.codec).option("maxRecordsPerFile", self.config.page_rows).partitionBy("shard").parquet(f"{self.path}/data/{folder}")
        return self._commit(folder, kind, replaces, shards, tag)

    # -- writes ------

    def append(self, postings: DataFrame, tag: str | None = None, once: bool = False) -> dict:
        """Insert or replace postings; one atomic generation a call. Of an identity that comes more than once the row with the
        greatest ord counts, any if there is no such column. once: it is known that each comes once, and in tasks of an even size, so
        that no shuffle is needed.
        tag: a name for the batch; if it was committed, nothing is done."""
        commits = self.commits()
        if tag is not None and (done := [c for c in commits if c.get("tag") == tag]):
            return done[0]
        rows = postings.select(*POSTINGS.fieldNames())
        if not once:
            rest = [c for c in POSTINGS.fieldNames() if c not in IDENTITY]
            order = "ord" if "ord" in postings.columns else F.lit(0)
            rows = postings.groupBy(*IDENTITY).agg(F.max_by(F.struct(*rest), order).alias("v")).select(*IDENTITY, "v.*")
        return self._write(rows.withColumn("deleted", F.lit(False)), "append", [], commits, tag, spread=not once)

    def delete(self, keys: DataFrame, report_missing: bool = True, once: bool = False) -> DataFrame:
        """keys (mailbox, attr, term, ts, id): remove these postings. Gives the keys that weren't there, read when asked for from
        the generations before this one, so before a vacuum() that deletes those. once: see append()."""
        commits = self.commits()
        keys = keys.select(*IDENTITY) if once else keys.select(*IDENTITY).distinct()
        missing = keys.join(self.read(commits=commits).select(*IDENTITY), IDENTITY, "left_anti") if report_missing else keys.limit(0)
        tombs = keys.select(*IDENTITY, *[F.lit(None).cast(t).alias(c) for c, t in (("bucket", "string"), ("key", "string"), ("positions", "array<bigint>"))], F.lit(True).alias("deleted"))
        self._write(tombs, "delete", [], commits, spread=not once)
        return missing

    def compact(self) -> dict | None:
        """Rewrite what is in force as one generation, sorted, without replaced and deleted postings. Conflict if another writer
        compacted meanwhile; what was appended meanwhile stays in force above it."""
        commits = self.commits()
        old = self.generations(commits)
        if not old or (len(old) == 1 and old[0]["kind"] == "compact"):
            return None
        return self._write(self.read(commits=commits).withColumn("deleted", F.lit(False)), "compact", [c["gen"] for c in old], commits)

    def vacuum(self, orphans_after: float | None = None) -> list[int]:
        """Delete the files of replaced generations, which no reader may use any more, and return their numbers. orphans_after:
        also folders that no commit names and that nothing was added to for so many seconds, left by writers that died."""
        commits = self.commits()
        gone = {g for c in commits for g in c["replaces"]}
        out = [c["gen"] for c in commits if c["gen"] in gone and self._fs.delete(self._path(f"{self.path}/data/{c['folder']}"), True)]
        data = self._path(f"{self.path}/data")
        if orphans_after is not None and self._fs.exists(data):
            named = {c["folder"] for c in commits}
            for s in self._fs.listStatus(data):
                if s.getPath().getName() not in named and time.time() - s.getModificationTime() / 1000 >= orphans_after:
                    self._fs.delete(s.getPath(), True)
        return out

    # -- reads ------

    def stored(self, terms: list[str] | None = None, file: bool = False, commits: list[dict] | None = None) -> DataFrame:
        """All stored rows in force with seq, replaced ones included; with terms only their shards' directories are read. file:
        with the path of each row's file. commits: what was read of them, so that a search reads them once."""
        commits = self.commits() if commits is None else commits
        gens = self.generations(commits)
        if not gens:
            return self.spark.createDataFrame([], T.StructType([*STORED.fields, SEQ, *([T.StructField("file", T.StringType())] if file else [])]))
        parts = []
        for g in gens:
            folder = f"{self.path}/data/{g['folder']}"
            rows = self.spark.read.schema(STORED).option("basePath", folder).parquet(folder)
            more = [F.col("_metadata.file_path").alias("file")] if file else []  # a union has no metadata column
            parts.append(rows.select("*", F.lit(g["seq"]).cast("bigint").alias("seq"), *more))
        rows = reduce(DataFrame.unionByName, parts)
        if terms is not None:
            shards = self._shards(commits)
            rows = rows.where(F.col("shard").isin(sorted({shard_of(t, shards) for t in terms})) & F.col("term").isin(list(terms)))
        return rows

    def read(self, terms: list[str] | None = None, commits: list[dict] | None = None, columns: list[str] | None = None, broadcast_rows: int = 4_000_000) -> DataFrame:
        """Postings in force, each identity once, or columns of them. Of one compacted or appended generation that needs no shuffle.

        Of several the postings are shuffled that are of documents in a later generation than the first; if these documents are more
        than broadcast_rows, and if only terms are read, all."""
        commits = self.commits() if commits is None else commits
        gens, columns = self.generations(commits), columns or POSTINGS.fieldNames()
        if len(gens) <= 1:
            return self.stored(terms, commits=commits).where("NOT deleted").select(*columns)
        own = [c for c in STORED.fieldNames() if c in IDENTITY or c == "deleted" or c in columns]
        if terms is None:
            changed = f"{shared_dir(self.spark)}/changed-{uuid.uuid4().hex}"  # a hash that is in it by chance only costs a shuffle
            doc = F.xxhash64("mailbox", "ts", "id").alias("doc")
            self.stored(commits=gens[1:]).select(doc).distinct().write.parquet(changed)
            changed = self.spark.read.parquet(changed)
            if changed.count() <= broadcast_rows:
                first, later = self.stored(commits=gens[:1]).select(*own, "seq", doc), self.stored(commits=gens[1:]).select(*own, "seq")
                same = first.join(F.broadcast(changed), "doc", "left_anti").where("NOT deleted")
                rest = first.join(F.broadcast(changed), "doc", "left_semi").drop("doc").unionByName(later)
                return same.select(*columns).unionByName(latest(rest.repartition(*IDENTITY)).select(*columns))
        return latest(self.stored(terms, commits=commits).select(*own, "seq")).select(*columns)


def latest(rows: DataFrame) -> DataFrame:
    """Of each posting the row with the greatest seq, unless that is a tombstone. A partial aggregation, then one shuffle."""
    rest = [c for c in rows.columns if c not in IDENTITY and c not in ("seq", "shard")]
    newest = rows.groupBy(*IDENTITY).agg(F.max_by(F.struct(*rest), "seq").alias("v"))
    return newest.select(*IDENTITY, "v.*").where("NOT deleted")
