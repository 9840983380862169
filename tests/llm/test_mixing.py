import hashlib
import math
import random
import re

import duckdb
import pandas as pd
import pytest

from lexigrid.llm import mixing
from lexigrid.llm.common import WORD_CHARS

from .helpers import awkward, documents, words


def bounded(t):
    return len(re.findall(rf"[^ \t\n\v\f\r]{{1,{WORD_CHARS}}}", t or ""))


def brute(rows, weights=None, default=1.0, fraction=0.5, budget=None, seed=mixing.SEED, n=bounded):
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    h = lambda i, t, s: md5(f"{seed}|{'' if i is None else i}|{s or ''}|{md5(t or '')}")
    queue = []
    for s in {r[3] for r in rows}:
        cum = 0
        for place, size, i in sorted(((h(r[0], r[1], s), n(r[1]), r[0]) for r in rows if r[3] == s), key=lambda x: x[:2]):
            cum += size
            queue.append((cum / (weights or {}).get(s, default), place, s is not None, s or "", i is not None, i or 0, size))
    budget = math.floor(sum(q[-1] for q in queue) * fraction) if budget is None else budget
    out, total = [], 0
    for q in sorted(queue):
        total += q[-1]
        if total > budget:
            break
        out.append((q[5] if q[4] else None, q[3] if q[2] else None, q[-1], q[0]))
    return out


def key(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("kw", [{}, {"weights": {"s1": 3.0, "s2": 0.5}}, {"fraction": 1.0}, {"fraction": 0.0}, {"budget": 300}])
@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, kw, small, monkeypatch):
    if small:  # many ranges, and several rounds of the search for the cut
        monkeypatch.setattr(mixing, "WINDOW_ROWS", 2)
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    rng = random.Random(1)
    rows = [(i, words(rng, rng.randint(0, 30)), "en", f"s{rng.randint(0, 3)}") for i in range(200)]
    args = {"weights": kw.get("weights"), "budget_fraction": kw.get("fraction", 0.5), "budget_tokens": kw.get("budget")}
    docs = documents(spark, rows)
    want = brute(rows, **kw)
    assert key(mixing.mix_sources(docs, **args).collect()) == key(want)
    assert sorted(r["doc_id"] for r in mixing.mixed_documents(docs, **args).collect()) == sorted(r[0] for r in want)


def test_shares_follow_weights(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, 10), "en", "hot" if i % 3 else "cold") for i in range(900)]
    got = mixing.mix_sources(documents(spark, rows), {"hot": 1.0, "cold": 2.0}, budget_tokens=3000).groupBy("source").sum("n_tokens").collect()
    share = {r[0]: r[1] for r in got}
    assert share["cold"] / share["hot"] == pytest.approx(2, rel=0.02)


def test_repeated_rows_ties_and_null_ids(spark, monkeypatch):
    """A row that makes a third of the table, and many rows without tokens or id at one time, are never in one window."""
    monkeypatch.setattr(mixing, "WINDOW_ROWS", 2)
    rng = random.Random(5)
    rows = [(7, "the same row", "en", "s0")] * 100 + [(None, "", "en", "s1")] * 50 + [(None, words(rng, 3), "en", "s2") for _ in range(80)] + [(i, "one", "en", f"own{i}") for i in range(70)]
    docs = documents(spark, rows)
    for fraction in (0.05, 0.3, 0.37, 0.8):
        want = brute(rows, fraction=fraction)
        assert key(mixing.mix_sources(docs, budget_fraction=fraction).collect()) == key(want)
        wide = mixing.mixed_documents(docs, budget_fraction=fraction)
        assert key((r["doc_id"], r["source"]) for r in wide.collect()) == key(r[:2] for r in want)


def test_sql(spark):
    rows = awkward(random.Random(6)) + [(400 + i, "x" * (17 * i) + "\x0by z", "en", f"src{i % 5}") for i in range(40)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(r[0], r[1], r[2], r[3]) for r in rows], columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"}))
    for weights in (None, mixing.TARGET_WEIGHTS):
        got = mixing.mix_sources(documents(spark, rows), weights).select("doc_id", "source", "n_tokens", "virtual_finish").collect()
        assert key(got) == key(con.execute(mixing.oracle_sql(weights=weights)).fetchall()) == key(brute(rows, weights))


def test_sorted(spark):
    rng = random.Random(3)
    out = mixing.mix_sources(documents(spark, [(i, words(rng, 9), "en", f"s{i % 3}") for i in range(100)])).collect()
    assert [r["virtual_finish"] for r in out] == sorted(r["virtual_finish"] for r in out)


def test_awkward(spark):
    rows = awkward(random.Random(4))
    docs = documents(spark, rows, clash=True)
    for fraction in (0.01, 0.5, 1.0):
        want = brute(rows, fraction=fraction)
        assert [r[:1] for r in key(mixing.mix_sources(docs, budget_fraction=fraction).collect())] == [r[:1] for r in key(want)]
        wide = mixing.mixed_documents(docs, budget_fraction=fraction)
        assert wide.columns == docs.columns and key((r["doc_id"], r["source"]) for r in wide.collect()) == key(r[:2] for r in want)
    assert len(wide.collect()) == len(rows)
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, {"s0": 0.0})
