import random

import pytest
from pyspark.sql import functions as F

from lexigrid.functions.timestamps import pack_py
from lexigrid.operators.intersect import count_matches, intersect, intersect_batch, intersect_by_joins
from lexigrid.operators.paging import page, page_info
from lexigrid.operators.postings import postings
from lexigrid.operators.rank import has_phrase, ranked, relevance
from lexigrid.plans.request import Cookie, Terms
from lexigrid.schema import VALUES


def make(spark, docs, mailbox="m", attr="text"):
    """docs: {id: text} or {(ts, id): text}"""
    rows = [(mailbox, k if isinstance(k, str) else k[1], "b", "k", 0 if isinstance(k, str) else k[0], attr, t) for k, t in docs.items()]
    return postings(spark.createDataFrame(rows, VALUES))


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(ivec, occurrences):
    """occurrences: sorted (position, rank)"""
    runs, last = [], None
    for p, r in occurrences:
        if last is None or p != last + 1:
            runs.append([])
        runs[-1].append(r)
        last = p
    n, best = len(ivec), {}
    for run in runs:
        at = 0
        while True:
            w = run[at : at + n]
            d = lev(list(ivec), w)
            best[d] = best.get(d, 0) + 1
            at += 1
            if len(w) < n:
                break
    d = min(best)
    return (1 - d / n) * best[d] / len(occurrences)


GOLDEN = [
    ("a", "x a a a", 1.0), ("a b", "a b", 0.5), ("a b", "b a", 0.25), ("a b", "a x b", 0.5), ("a b", "a b x a b", 0.5), ("a b", "a b a b", 0.5),
    ("a b", "x a x b x a b", 0.25), ("a b c", "a b c", 1 / 3), ("a b c", "a c b", 2 / 9), ("a b c", "a b x c", 2 / 9), ("a a", "a a", 0.5), ("a b a c", "a b a c", 0.25), ("a a b", "a a b", 1 / 3),
]


@pytest.mark.parametrize("query,doc,want", GOLDEN)
def test_golden_relevance(spark, query, doc, want):
    terms = Terms.of({"text": query})
    got = relevance(intersect(make(spark, {"d": doc}), "m", terms), terms).first()["relevance"]
    assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("query,doc,want", [("a b a c", "a b a c", 0.1875), ("a a b", "a a b", 2 / 9)])
def test_golden_relevance_compat(spark, query, doc, want):
    terms = Terms.of({"text": query}, compat_ivec=True)
    assert relevance(intersect(make(spark, {"d": doc}), "m", terms), terms).first()["relevance"] == pytest.approx(want, abs=1e-6)


def test_relevance_against_brute_force(spark):
    rng = random.Random(5)
    docs = {f"d{i}": " ".join(rng.choice("abcdx") for _ in range(rng.randint(1, 30))) for i in range(150)}
    p = make(spark, docs).cache()
    for query in ("a b", "c a b", "a b a"):
        terms = Terms.of({"text": query})
        got = {r["id"]: r["relevance"] for r in relevance(intersect(p, "m", terms), terms).collect()}
        local = {t: r for (_, t), r in terms.local_rank().items()}
        want = {k: brute(terms.ivec["text"], [(i, local[w]) for i, w in enumerate(d.split()) if w in local]) for k, d in docs.items() if set(local) <= set(d.split())}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_intersection_walk(spark):
    lists = {"a": "d0 d2 d3 d4 d5", "b": "d2 d3 d4", "c": "d3 d4 d5", "d": "d3 d4 d5"}
    docs = {}
    for term, ids in lists.items():
        for d in ids.split():
            docs[int(d[1:]), d] = docs.get((int(d[1:]), d), "") + " " + term
    p, terms = make(spark, docs), Terms.of({"text": "a b c d"})
    found = intersect(p, "m", terms)
    assert [r["id"] for r in page(found, None).collect()] == ["d3", "d4"]
    assert [x["term"] for x in found.first()["indexes"]] == list("abcd")
    info = page_info(found, 1).first()
    assert (info["num"], info["completed"], info["start"]) == (1, False, "4:d4")
    rest = intersect(p, "m", terms, Cookie.parse(info["start"]))
    assert [r["id"] for r in page(rest, 1).collect()] == ["d4"] and page_info(rest, 1).first()["completed"]
    zero = page_info(found, 0).first()
    assert (zero["num"], zero["completed"]) == (0, False)


def test_rules(spark):
    p = make(spark, {"d1": "a b", "d2": "a"})
    none = lambda q: intersect(p, "m", Terms.of(q)).count()
    assert none({}) == none({"text": "a zzz"}) == none({"text": "..."}) == 0
    assert intersect(p, "other", Terms.of({"text": "a"})).count() == 0
    assert none({"text": "A a a"}) == 2


def test_attributes_are_kept_apart(spark):
    p = make(spark, {"d": "x"}, attr="a").unionByName(make(spark, {"d": "y", "e": "x y"}, attr="a.b"))
    assert [r["id"] for r in intersect(p, "m", Terms.of({"a": "x", "a.b": "y"})).collect()] == ["d"]


def test_pages_concatenate_and_other_plans_agree(spark):
    rng = random.Random(1)
    docs = {(rng.randint(0, 5), f"d{i:03}"): " ".join(rng.choice("abc") for _ in range(4)) for i in range(100)}
    p, terms = make(spark, docs).cache(), Terms.of({"text": "a b"})
    whole = [(r["ts"], r["id"]) for r in page(intersect(p, "m", terms), None).collect()]
    assert whole == sorted(k for k, t in docs.items() if {"a", "b"} <= set(t.split()))
    assert sorted(map(tuple, intersect_by_joins(p, "m", terms).collect())) == whole
    for size in (7, len(whole), len(whole) + 1):
        got, cookie = [], None
        while True:
            found = intersect(p, "m", terms, cookie)
            got += [(r["ts"], r["id"]) for r in page(found, size).collect()]
            info = page_info(found, size).first()
            if info["completed"]:
                break
            cookie = Cookie.parse(info["start"])
        assert got == whole
    asked = spark.createDataFrame([("q", "m", "text", "a", 0), ("q", "m", "text", "b", 1), ("r", "m", "text", "c", 0)], "qid string, mailbox string, attr string, term string, ord int")
    for limit in (0, 100):
        rows = intersect_batch(p, asked, limit).collect()
        assert sorted((r["ts"], r["id"]) for r in rows if r["qid"] == "q") == whole


def test_ranked_and_phrase(spark):
    p, terms = make(spark, {(1, "far"): "a x b", (2, "near"): "a b", (3, "back"): "b a", (0, "none"): "a"}), Terms.of({"text": "a b"})
    found = intersect(p, "m", terms)
    assert [r["id"] for r in ranked(found, terms).collect()] == ["far", "near", "back"]
    assert [r["id"] for r in found.where(has_phrase(terms)).collect()] == ["near"]


def test_last_attribute_counts(spark):
    p = make(spark, {"d": "a b"}, attr="t").unionByName(make(spark, {"d": "y x"}, attr="u"))
    terms = Terms.of({"t": "a b", "u": "x y"})
    found = intersect(p, "m", terms)
    assert [round(relevance(found, terms, c).first()["relevance"], 3) for c in ("last", "max", "mean")] == [0.25, 0.5, 0.375]


def test_plan_pushes_filters_and_shuffles_once(spark, tmp_path):
    path = str(tmp_path / "p")
    make(spark, {(i, f"d{i}"): "a b c" for i in range(50)}).write.parquet(path)
    plan = intersect(spark.read.parquet(path), "m", Terms.of({"text": "a b"}), Cookie(3, "d3"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "EqualTo(mailbox,m)" in plan and "In(term" in plan and "GreaterThan(ts,3)" in plan
    assert pack_py(0) == 0


@pytest.mark.parametrize("n", [222, 223, 224, 300])
def test_many_words(spark, n):
    """As many different words as a query likes, on both sides of what a byte can number."""
    rng = random.Random(n)
    asked = [f"w{i}" for i in range(n)]
    texts = {"same": asked, "turned": asked[::-1], "mixed": rng.sample(asked, n) + ["x", *asked[: n // 2]]}
    terms = Terms.of({"text": " ".join(asked)})
    hits = intersect(make(spark, {k: " ".join(v) for k, v in texts.items()}), "m", terms)
    got = {r["id"]: r["relevance"] for r in relevance(hits, terms).collect()}
    rank = {w: i for i, w in enumerate(asked)}
    for k, v in texts.items():
        assert got[k] == pytest.approx(brute(terms.ivec["text"], [(p, rank[w]) for p, w in enumerate(v) if w in rank]), abs=1e-9)


def test_postings_need_no_shuffle(spark):
    p = make(spark, {"a": "x y x", "b": "", "c": None, (5, "a"): "y"})
    assert "Exchange" not in p._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["id"], r["ts"], r["term"], r["positions"]) for r in p.collect()) == [("a", 0, "x", [0, 2]), ("a", 0, "y", [1]), ("a", 5, "y", [0])]


def test_repeated_identities_count_once(spark):
    p = make(spark, {"d1": "a b", "d2": "a"})
    twice = p.unionByName(p)
    for query, want in (({"text": "a b"}, ["d1"]), ({"text": "a zzz"}, []), ({"text": "a"}, ["d1", "d2"])):
        terms = Terms.of(query)
        found = intersect(twice, "m", terms).collect()
        assert sorted(r["id"] for r in found) == want and all(len(r["indexes"]) == len(terms.lists) for r in found)
        assert count_matches(twice, "m", terms).first()["n"] == len(want)
        asked = spark.createDataFrame([("q", "m", a, t, i) for i, (a, t) in enumerate(terms.lists)], "qid string, mailbox string, attr string, term string, ord int")
        assert sorted(r["id"] for r in intersect_batch(twice, asked).collect()) == want


def test_relevance_needs_no_shuffle(spark):
    found = make(spark, {"d1": "a b x b a", "d2": "b a"}).groupBy("ts", "id").agg(F.collect_list(F.struct("attr", "term", "positions")).alias("indexes"))
    plan = relevance(found, Terms.of({"text": "a b"}))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Exchange") == 0 and "Join" not in plan and "Window" not in plan and plan.count("Aggregate") <= 2
