import json

import pytest
from pyspark.sql import functions as F

from lexigrid.config import EngineConfig
from lexigrid.functions.timestamps import pack_py
from lexigrid.operators.postings import postings
from lexigrid.operators.store import Conflict, PostingStore
from lexigrid.plans.engine import Engine
from lexigrid.plans.request import BadRequest, SearchRequest
from lexigrid.schema import VALUES
from lexigrid.sources import requests
from lexigrid.streaming.ingest import follow

MIXED = json.dumps(
    {
        "mailbox": "m",
        "docs": [
            {"id": "d1", "bucket": "b", "key": "k", "timestamp": {"tsec": 10, "tnsec": 1}, "index": {"text": "a b a", "n": 5, "o": {"x": 1}, "z": None, "t": True}},
            {"bucket": ""},
            {"id": 7, "bucket": "b", "key": "k", "index": {"text": "num id"}},
            "notobj",
            {"id": "d2", "bucket": "b", "key": "k", "timestamp": {"tsec": 11}, "index": {"text": "b c"}},
            {"id": "d3", "bucket": "b", "key": "k", "index": "str"},
        ],
    }
)


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def doc(i, text, sec=1):
    return {"id": i, "bucket": "b", "key": "k-" + i, "timestamp": {"tsec": sec, "tnsec": 0}, "index": {"text": text}}


def request(*docs, mailbox="m"):
    return json.dumps({"mailbox": mailbox, "docs": list(docs)})


def test_lenient_requests(spark):
    docs = requests.documents(lines(spark, MIXED, "not json", '{"mailbox": 5, "docs": []}', '{"mailbox": "m", "docs": {}}'), now=99)
    rows = {r["id"]: r for r in docs.drop("index").collect()}
    assert rows.keys() == {"d1", "d2"}
    assert rows["d1"]["ts"] == pack_py(10, 1) and rows["d2"]["ts"] == pack_py(11, 0)
    assert sorted((r["id"], r["attr"], r["value"]) for r in requests.values(docs).collect()) == [("d1", "text", "a b a"), ("d2", "text", "b c")]
    assert [(r["docs"], r["valid"], r["status"]) for r in requests.outcome(lines(spark, MIXED, "{")).collect()] == [(6, 2, 200), (0, 0, 400)]


def test_life_of_an_index(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/ix", EngineConfig(shards=4))
    assert e.ping() and not e.store.exists() and e.page_files().count() == e.meta().count() == 0 and e.search(SearchRequest("m", {"text": "a"})).docs == []
    e.index_json(request(doc("d1", "a b", 1), doc("d2", "a c", 2), doc("d3", "a b", 3)))
    with pytest.raises(BadRequest):
        e.index_json(request({"id": "x"}))
    first = e.search('{"mailbox": "m", "query": {"text": "a"}, "paging": {"num": 2}}')
    assert [d["id"] for d in first.docs] == ["d1", "d2"] and not first.completed
    second = e.search(SearchRequest("m", {"text": "a"}, 2, first.start))
    assert [d["id"] for d in second.docs] == ["d3"] and second.completed and second.start == ""
    assert [len(p.docs) for p in e.pages(SearchRequest("m", {"text": "a"}, 1))] == [1, 1, 1]
    answer = json.loads(first.to_json())
    assert answer["ids"][0] == {"key": "k-d1", "bucket": "b", "id": "d1", "relevance": 1.0, "timestamp": {"tsec": 1, "tnsec": 0}}
    assert answer["paging"] == {"num": 2, "start": f"{pack_py(3)}:d3"}
    assert e.search(SearchRequest("m", {}, 2, "1:x")).start == "1:x"
    assert e.search(SearchRequest("m", {"text": "nope"}, 2, "1:x")).start == "1:x"
    # the same identity again replaces, another timestamp adds
    e.index_json(request(doc("d1", "a z", 1), doc("d2", "a", 9)))
    n = e.never_fewer(SearchRequest("m", {"text": "a"}), 3)
    assert n == 4
    assert e.lookup("m", "text", "z", pack_py(1), "d1").count() == 1
    # removal, of a missing key too
    keys = spark.createDataFrame([("m", "text", "a", pack_py(2), "d2"), ("m", "text", "a", 0, "none")], "mailbox string, attr string, term string, ts bigint, id string")
    missing = e.remove(keys)
    assert [r["id"] for r in missing.collect()] == [r["id"] for r in missing.collect()] == ["none"]
    before = sorted(map(str, e.store.read().collect()))
    assert sum(r["num_keys"] for r in e.page_files().collect()) == e.store.stored().count()
    assert {r["term"]: r["num_keys"] for r in e.meta().collect()} == {r["term"]: r["count"] for r in e.store.read().groupBy("term").count().collect()}
    assert e.search(SearchRequest("m", {"text": "a"})).completed and e.never_fewer(SearchRequest("m", {"text": "a"}), 0) == 3
    e.compact()
    assert e.compact() is None
    assert sorted(map(str, e.store.read().collect())) == before
    plan = e.store.read(["a"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PartitionFilters: [isnotnull(shard" in plan
    assert e.store.vacuum() == [1, 2, 3]
    meta = {(r["attr"], r["term"]): r for r in e.meta().collect()}
    assert meta["text", "a"]["num_keys"] == 3 and meta["text", "a"]["num_files"] == 1 and meta["text", "a"]["generation_sec"] > 0
    assert sum(r["num_keys"] for r in e.page_files().collect()) == e.store.read().count()
    assert [r["id"] for r in e.keys("m", "text", "a").collect()] == ["d1", "d3", "d2"]
    assert [r["id"] for r in e.keys("m", "text", "a", (pack_py(3), "d3")).collect()] == ["d3", "d2"]
    many = e.search_many({"x": SearchRequest("m", {"text": "a z"}), "y": SearchRequest("m", {"text": "b"})})
    assert sorted((r["qid"], r["id"]) for r in many.collect()) == [("x", "d1"), ("y", "d1"), ("y", "d3")]
    assert e.best(SearchRequest("m", {"text": "a z"}), 1).first()["id"] == "d1"
    e.remove_documents(spark.createDataFrame([("m", pack_py(1), "d1")], "mailbox string, ts bigint, id string"))
    assert e.never_fewer(SearchRequest("m", {"text": "a"}), 0) == 2


def test_read_only_and_second_writer(spark, tmp_path):
    path = f"file://{tmp_path}/ix"
    e = Engine(spark, path, EngineConfig(shards=2))
    e.index_json(request(doc("d", "a")))
    with pytest.raises(PermissionError):
        Engine(spark, path, EngineConfig(read_only=True)).index_json(request(doc("e", "a")))


def contents(store):
    return sorted((r["term"], r["id"], r["key"]) for r in store.read().collect())


def batch(spark, key, *terms):
    return postings(spark.createDataFrame([("m", i, "b", key, 0, "text", t) for i, t in terms], VALUES))


def test_a_writer_that_dies_loses_nothing(spark, tmp_path, monkeypatch):
    """It leaves its folder, and perhaps a commit file without its content; the next batch is seen all the same."""
    store = PostingStore(spark, f"file://{tmp_path}/ix", EngineConfig(shards=2))
    store.append(batch(spark, "k1", ("d1", "a")))
    with monkeypatch.context() as m:
        m.setattr(PostingStore, "_commit", lambda *a: (_ for _ in ()).throw(OSError("died")))
        with pytest.raises(OSError):
            store.append(batch(spark, "lost", ("d1", "a"), ("d9", "a")))
    assert contents(store) == [("a", "d1", "k1")]
    (tmp_path / "ix" / "commits" / f"{2:012d}.json").write_text('{"gen": 2, "se')
    assert contents(store) == [("a", "d1", "k1")] and len(store.commits()) == 1
    store.append(batch(spark, "k3", ("d2", "a")))
    store.append(batch(spark, "k4", ("d1", "a")))
    assert contents(store) == [("a", "d1", "k4"), ("a", "d2", "k3")] and [c["gen"] for c in store.commits()] == [1, 3, 4]
    assert len(list((tmp_path / "ix" / "data").iterdir())) == 4
    assert store.vacuum(3600) == [] and len(list((tmp_path / "ix" / "data").iterdir())) == 4
    store.vacuum(0)
    assert len(list((tmp_path / "ix" / "data").iterdir())) == 3 and len(contents(store)) == 2


def test_two_writers_at_once(spark, tmp_path):
    path = f"file://{tmp_path}/ix"
    a, b = PostingStore(spark, path, EngineConfig(shards=2)), PostingStore(spark, path, EngineConfig(shards=2))
    a.append(batch(spark, "k1", ("d1", "a"), ("d2", "a")))
    a.append(batch(spark, "k2", ("d2", "a")))
    commit, raced = a._commit, []

    def late(folder, kind, *rest):
        if not raced:
            raced.append(b.append(batch(spark, "k3", ("d1", "a"))))  # while a's rows are written, before its commit
        return commit(folder, kind, *rest)

    a._commit = late
    done = a.append(batch(spark, "k4", ("d3", "a")))
    assert [raced[0]["gen"], done["gen"]] == [3, 4]
    want = [("a", "d1", "k3"), ("a", "d2", "k2"), ("a", "d3", "k4")]
    assert contents(a) == want
    raced.clear()
    a.compact()  # b replaces d1 meanwhile: the compacted rows are older
    assert contents(a) == want and a.generations()[0]["kind"] == "append" and a.commits()[-1]["seq"] == 4
    reader = a.commits
    a.commits = lambda: reader()[:-2]  # a saw the generations before they were compacted
    folder = a.commits()
    del a.commits, a._commit
    with pytest.raises(Conflict):
        a._write(a.read(commits=folder).withColumn("deleted", F.lit(False)), "compact", [c["gen"] for c in folder], folder)
    numbers = a._commit_numbers
    a._commit_numbers = lambda: numbers()[:-1] if not raced.append(1) and len(raced) < 2 else numbers()  # a number that another takes first
    assert a.append(batch(spark, "k9", ("d9", "a")))["gen"] == max(numbers())


def test_last_of_a_batch_counts(spark, tmp_path):
    """A document twice in a batch is as two batches; a tagged batch is taken once."""
    e = Engine(spark, f"file://{tmp_path}/ix", EngineConfig(shards=2))
    e.index_json(request(doc("d", "a b"), doc("d", "x a")))
    got = {r["term"]: r["positions"] for r in e.store.read().collect()}
    assert got == {"a": [1], "b": [1], "x": [0]}
    rows = e.store.read()
    e.store.append(rows.unionByName(rows).where("term = 'a'"), "t")
    assert e.store.append(rows, "t")["gen"] == 2 and len(e.store.commits()) == 2
    assert e.store.read().where("term = 'a'").count() == 1 and e.search(SearchRequest("m", {"text": "a zzz"})).docs == []


def test_one_read_of_commits_a_search(spark, tmp_path, monkeypatch):
    e = Engine(spark, f"file://{tmp_path}/ix", EngineConfig(shards=2))
    for i in range(3):
        e.index_json(request(doc(f"d{i}", "a b c")))
    read, seen = PostingStore._read, []
    monkeypatch.setattr(PostingStore, "_read", lambda self, n: seen.append(n) or read(self, n))
    e.search(SearchRequest("m", {"text": "a b c"}, 10))
    assert len(seen) == 3


def test_same_analyzer_on_both_sides(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/ix", EngineConfig(shards=2), analyzer=lambda c: F.split(F.upper(c), "-"))
    e.index_json(request(doc("d", "hello-there you"), doc("e", "hello-x")))
    assert [d["id"] for d in e.search(SearchRequest("m", {"text": "Hello-There you"}, 5)).docs] == ["d"]
    assert e.search(SearchRequest("m", {"text": "hello there"})).docs == []
    assert e.search_many({"q": SearchRequest("m", {"text": "HELLO"})}).count() == 2
    assert e.results(SearchRequest("m", {"text": "hello"}, 1)).count() == 2


def test_ranking_of_a_request(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/ix", EngineConfig(shards=2))
    e.index_json(request(doc("d", "a a b") | {"index": {"text": "a a b", "title": "b a"}}))
    one = SearchRequest.from_json('{"mailbox": "m", "query": {"text": "a a b"}, "ranking": {"compat_ivec": true}}')
    assert one.compat_ivec and SearchRequest.from_json(one.to_json()) == one
    assert round(e.search(one).docs[0]["relevance"], 6) == 0.222222
    assert round(e.search(SearchRequest("m", {"text": "a a b"})).docs[0]["relevance"], 6) == 0.333333
    both = {"text": "a", "title": "a b"}
    assert [e.search(SearchRequest("m", both, combine=c)).docs[0]["relevance"] for c in (None, "max", "mean")] == [0.25, 1.0, 0.625]


def test_dump_of_one_page(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/ix", EngineConfig(shards=1))
    e.index_json(request(doc("d2", "b a", 2), doc("d1", "a", 1)))
    file = e.page_files().orderBy("num_keys").collect()
    rows = [(r["place"], r["term"], r["id"], r["positions"]) for f in file for r in e.page_dump(f["file"]).collect()]
    assert sorted(r[1:] for r in rows) == [("a", "d1", [0]), ("a", "d2", [1]), ("b", "d2", [0])]
    assert [r[0] for r in rows][: file[0]["num_keys"]] == list(range(file[0]["num_keys"]))


def test_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    e = Engine(spark, f"file://{tmp_path}/ix", EngineConfig(shards=2, now=5))
    for n, text in enumerate([request(doc("d1", "a b", 50)) + "\nnot json", request(doc("d2", "a", 3))]):
        (inbox / f"{n}.json").write_text(text)
        follow(e, str(inbox), str(tmp_path / "cp"), compact_every=2, available_now=True).awaitTermination(120)
    assert [d["id"] for d in e.search(SearchRequest("m", {"text": "a"})).docs] == ["d2", "d1"]


def test_pages_read_the_index_once(spark, tmp_path, monkeypatch):
    e = Engine(spark, f"file://{tmp_path}/ix", EngineConfig(shards=2))
    e.index(lines(spark, *[request(doc(f"d{i}", "a b " * (i % 3 + 1), i // 2)) for i in range(23)]))
    asked = SearchRequest("m", {"text": "a b"}, 4)
    want, at = [], asked
    while not want or want[-1].start:
        want.append(e.search(at))
        at = asked.at(want[-1].start)
    read, scans = e.store.read, []
    monkeypatch.setattr(e.store, "read", lambda *args: scans.append(args) or read(*args))
    assert list(e.pages(asked)) == want and len(want) == 6
    assert len(scans) == 1
    rows = e.all_pages(asked).collect()
    assert sorted((r["page"], r["id"]) for r in rows) == sorted((n, d["id"]) for n, p in enumerate(want) for d in p.docs)
    assert [len(p.docs) for p in e.pages(asked.at(want[-2].start))] == [3]
    assert list(e.pages(SearchRequest("m", {"text": "none"}, 4, "1:x"))) == [e.search(SearchRequest("m", {"text": "none"}, 4, "1:x"))]


def shuffles(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("Exchange hashpartitioning") + df._jdf.queryExecution().sparkPlan().toString().count("Exchange rangepartitioning") + df._jdf.queryExecution().optimizedPlan().toString().count("Sort [")


def test_new_documents_are_written_without_a_shuffle_of_postings(spark, tmp_path, monkeypatch):
    e = Engine(spark, f"file://{tmp_path}/ix", EngineConfig(shards=4))
    plans, write = [], e.store._write
    monkeypatch.setattr(e.store, "_write", lambda *args, **more: plans.append(more) or write(*args, **more))
    e.index(lines(spark, *[request(doc(f"d{i}", f"a w{i} b a", i)) for i in range(40)]))
    e.remove_documents(spark.createDataFrame([("m", pack_py(3), "d3"), ("m", pack_py(9), "none")], "mailbox string, ts bigint, id string"))
    assert [m["spread"] for m in plans] == [False, False]
    files = e.generation_dump()
    assert files.groupBy("file").count().count() == e.page_files().count()
    for r in files.orderBy("file", "place").groupBy("file").agg(F.collect_list(F.struct("mailbox", "attr", "term", "ts", "id")).alias("k")).collect():
        assert r["k"] == sorted(r["k"])
    assert sorted(r["id"] for r in e.matches(SearchRequest("m", {"text": "a b"})).collect()) == sorted(f"d{i}" for i in range(40) if i != 3)


def test_only_changed_documents_are_merged(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/ix", EngineConfig(shards=4))
    e.index(lines(spark, *[request(doc(f"d{i}", f"a w{i} b", i)) for i in range(20)]))
    e.remove_documents(spark.createDataFrame([("m", pack_py(i), f"d{i}") for i in (3, 4)], "mailbox string, ts bigint, id string"))
    e.index(lines(spark, request(doc("d4", "a z", 4), doc("d5", "a b", 5), doc("new", "b", 5))))
    e.index(lines(spark, request(doc("d4", "z z", 4))))
    own = sorted(map(str, e.store.read().collect()))
    assert own == sorted(map(str, e.store.read(broadcast_rows=0).collect()))
    assert own == sorted(map(str, e.store.read(sorted({r["term"] for r in e.store.stored().collect()})).collect()))
    plan = e.store.read()._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" in plan
    assert "positions" not in e.store.read(columns=["mailbox", "term"])._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


def test_a_dump_of_a_generation_sorts_nothing(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/ix", EngineConfig(shards=4))
    e.index(lines(spark, *[request(doc(f"d{i}", f"a w{i} b", i)) for i in range(9)]))
    rows = e.generation_dump()
    assert shuffles(rows) == 0 and rows.count() == e.store.stored().count()
    one = rows.first()["file"]
    assert [r["place"] for r in e.page_dump(one).collect()] == list(range(rows.where(F.col("file") == one).count()))
