"""The engine: index documents, search them, scan and repair the index."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.config import EngineConfig
from lexigrid.functions.text import words
from lexigrid.functions.timestamps import unpack_py
from lexigrid.operators import catalog
from lexigrid.operators.intersect import intersect, intersect_batch
from lexigrid.operators.paging import page, paged, top_k
from lexigrid.operators.postings import Analyzer, arrived, postings
from lexigrid.operators.rank import has_phrase, ranked, scored
from lexigrid.operators.store import PostingStore
from lexigrid.plans.request import BadRequest, SearchRequest, Terms
from lexigrid.schema import IDENTITY
from lexigrid.sources import requests

#: Bytes of values that a task indexes, so many that their postings are sorted in memory (about 20 bytes of it a byte), and the
#: least for which it is worth a task while there are cores.
TASK_BYTES, LEAST_BYTES = 24 << 20, 1 << 20


@dataclass(frozen=True)
class SearchResult:
    """docs: rows with id, bucket, key, ts, relevance, indexes, most relevant first within the page."""

    docs: list
    completed: bool
    start: str

    def to_json(self) -> str:
        ids = [{"key": d["key"], "bucket": d["bucket"], "id": d["id"], "relevance": d["relevance"], "timestamp": dict(zip(("tsec", "tnsec"), unpack_py(d["ts"])))} for d in self.docs]
        return json.dumps({"ids": ids, "completed": self.completed, "paging": {"num": len(ids), "start": self.start}}, ensure_ascii=False)


class Engine:
    """analyzer: a column function from an attribute's text to its words. combine: how several attributes make one relevance."""

    def __init__(self, spark: SparkSession, path: str, config: EngineConfig | None = None, analyzer: Analyzer = words, combine: str = "last") -> None:
        self.spark, self.config, self.analyzer, self.combine = spark, config or EngineConfig(), analyzer, combine
        self.store = PostingStore(spark, path, self.config)

    def terms(self, request: SearchRequest) -> Terms:
        """The request's words, by the analyzer that documents are indexed with."""
        if self.analyzer is words:
            return request.terms
        texts = list(request.query.values())
        if not texts:
            return request.terms
        row = self.spark.range(1).select(*[self.analyzer(F.lit(t)).alias(f"a{i}") for i, t in enumerate(texts)]).first()
        split = dict(zip(texts, row))
        return request.words_by(lambda t: list(split[t] or []))

    def ping(self) -> bool:
        return self.spark.range(1).count() == 1

    # -- writing -------------------------------------------------------------------------------------------------------

    def index_values(self, values: DataFrame, tag: str | None = None) -> dict:
        """A batch of attribute values (schema.VALUES); all or nothing becomes visible. A posting that comes more than once is that
        of the last value, as if they were indexed one after the other. tag: see PostingStore.append."""
        each = values.groupBy("mailbox", "attr", "ts", "id").agg(F.count("*").alias("n"), F.sum(F.octet_length("value").cast("bigint")).alias("bytes"))
        most, size = each.agg(F.max("n"), F.sum("bytes")).first()
        if (most or 0) > 1:
            return self.store.append(postings(arrived(values), self.analyzer), tag)
        cores = self.spark.sparkContext.defaultParallelism
        parts = max(1, -(-(size or 0) // TASK_BYTES), min(cores, (size or 0) // LEAST_BYTES))
        own = values.repartition(parts, "mailbox", "ts", "id")
        return self.store.append(postings(own, self.analyzer, self.store.shards()), tag, once=True)

    def index(self, requests_: DataFrame, text: str = "value") -> dict:
        """A batch of JSON index requests, one a row. BadRequest if no document in it is valid."""
        docs = requests.documents(requests_, text, self.config.now)
        if docs.isEmpty():
            raise BadRequest("no valid document")
        return self.index_values(requests.values(docs))

    def index_json(self, text: str) -> dict:
        return self.index(self.spark.createDataFrame([(text,)], "value string"))

    def remove(self, keys: DataFrame) -> DataFrame:
        """Remove postings by (mailbox, attr, term, ts, id); gives those that weren't there."""
        return self.store.delete(keys)

    def remove_documents(self, documents: DataFrame, broadcast_rows: int = 2_000_000) -> None:
        """Remove all postings of documents (mailbox, ts, id), which are broadcast if they are at most broadcast_rows."""
        own = documents.select("mailbox", "ts", "id").distinct()
        small = own.limit(broadcast_rows + 1).count() <= broadcast_rows
        keys = self.store.read(columns=IDENTITY).join(F.broadcast(own) if small else own, ["mailbox", "ts", "id"], "left_semi").select(*IDENTITY)
        self.store.delete(keys, report_missing=False, once=True)

    def compact(self) -> dict | None:
        return self.store.compact()

    # -- reading -------------------------------------------------------------------------------------------------------

    def postings(self, request: SearchRequest) -> DataFrame:
        return self.store.read([t for _, t in self.terms(request).lists])

    def matches(self, request: SearchRequest, finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """All documents that match, from the request's cookie on, unordered and unranked."""
        terms = self.terms(request)
        found = intersect(self.store.read([t for _, t in terms.lists]), request.mailbox, terms, request.cookie)
        return found.transform(finish) if finish else found

    def _ranked(self, request: SearchRequest, hits: DataFrame, phrase: bool) -> DataFrame:
        return ranked(hits, self.terms(request), request.combine or self.combine, phrase and request.match == "phrase")

    def results(self, request: SearchRequest, finish: Callable[[DataFrame], DataFrame] | None = None, phrase: bool = False) -> DataFrame:
        """All matches from the request's cookie on, most relevant first, whatever its num: a DataFrame, nothing of which comes to
        the driver."""
        return self._ranked(request, self.matches(request, finish), phrase)

    def search(self, request: SearchRequest | str, finish: Callable[[DataFrame], DataFrame] | None = None, phrase: bool = False) -> SearchResult:
        """A page of the matches by (ts, id), then ranked within itself. Without a num all matches come to the driver, as rows of
        the result; results() leaves them where they are."""
        if isinstance(request, str):
            request = SearchRequest.from_json(request)
        if not self.terms(request).lists:
            return SearchResult([], True, request.start)
        num = request.num
        if num is None:
            hits = self.results(request, finish, phrase).collect()
            return SearchResult(hits, True, "" if hits else request.start)
        found = self.matches(request, finish)
        rows = page(found, num + 1).collect()
        if not rows:
            return SearchResult([], True, request.start)
        completed = len(rows) <= num
        start = "" if completed else f"{rows[num]['ts']}:{rows[num]['id']}"
        hits = rows if completed else rows[:num]
        if hits:
            hits = self._ranked(request, self.spark.createDataFrame(hits, found.schema), phrase).collect()
        return SearchResult(hits, completed, start)

    def all_pages(self, request: SearchRequest) -> DataFrame:
        """All matches from the request's cookie on with relevance and page, the number from 0 of the page of request.num that each
        is on: a DataFrame by one scan, nothing of which comes to the driver."""
        terms = self.terms(request)
        found = intersect(self.store.read([t for _, t in terms.lists]), request.mailbox, terms, request.cookie)
        return scored(paged(found, request.num), terms, request.combine or self.combine)

    def pages(self, request: SearchRequest):
        """Every page of a request in turn, as search() gives them from cookie to cookie. One scan answers them all, as the index is
        when the first is asked for; the driver holds two pages and what a task gives."""
        if not request.num or not self.terms(request).lists:
            yield self.search(request)
            return
        rows = self.all_pages(request)
        rows = rows.orderBy("page", F.desc("relevance"), "ts", "id").select("page", F.struct(*[c for c in rows.columns if c != "page"]).alias("d"))
        last: list = []
        for _, group in groupby(rows.toLocalIterator(), lambda r: r["page"]):
            docs = [r["d"] for r in group]
            if last:
                first = min(docs, key=lambda d: (d["ts"], d["id"].encode()))
                yield SearchResult(last, False, f"{first['ts']}:{first['id']}")
            last = docs
        yield SearchResult(last, True, "" if last else request.start)

    def best(self, request: SearchRequest, k: int) -> DataFrame:
        """The k most relevant of all matches, as an extension."""
        return top_k(self.results(request), k)

    def search_many(self, requests_: dict[str, SearchRequest]) -> DataFrame:
        """(qid, ts, id, bucket, key) of many requests, by one scan."""
        rows = [(q, r.mailbox, a, t, i) for q, r in requests_.items() for i, (a, t) in enumerate(self.terms(r).lists)]
        asked = self.spark.createDataFrame(rows, "qid string, mailbox string, attr string, term string, ord int")
        return intersect_batch(self.store.read(sorted({r[3] for r in rows})), asked)

    def keys(self, mailbox: str, attr: str, term: str, start: tuple[int, str] | None = None) -> DataFrame:
        return catalog.scan(self.store.read([term]), mailbox, attr, term, start)

    def lookup(self, mailbox: str, attr: str, term: str, ts: int, id: str) -> DataFrame:  # noqa: A002
        return catalog.lookup(self.store.read([term]), mailbox, attr, term, ts, id)

    def phrases(self, request: SearchRequest) -> DataFrame:
        """The matches in which every attribute's words stand next to each other in order, as an extension."""
        return self.matches(request).where(has_phrase(self.terms(request)))

    def meta(self) -> DataFrame:
        return catalog.store_meta(self.store)

    def page_files(self) -> DataFrame:
        return catalog.pages(self.store)

    def page_dump(self, file: str) -> DataFrame:
        return catalog.page_dump(self.spark, file)

    def generation_dump(self) -> DataFrame:
        """What every file of the generations in force holds: see catalog.folder_dump."""
        folders = [f"{self.store.path}/data/{g['folder']}" for g in self.store.generations()]
        return reduce(DataFrame.unionByName, [catalog.folder_dump(self.spark, f) for f in folders])

    def never_fewer(self, request: SearchRequest, before: int) -> int:
        """How many documents match now; an error if they are fewer than before, though none was removed."""
        n = self.matches(request).select(F.count("*")).first()[0]
        if n < before:
            raise AssertionError(f"{n} documents match, {before} did before")
        return n
