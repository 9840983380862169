import random

import duckdb
import pandas as pd

from lexigrid.llm import line_dedup as L

from .helpers import DOCS, awkward, documents, words


def brute(rows, min_sites):
    sites: dict[str, set] = {}
    trim = lambda x: x.strip(" \t\r")
    for _, t, _, s in rows:
        for line in (t or "").split("\n") if t is not None else []:
            if s is not None and trim(line):
                sites.setdefault(trim(line), set()).add(s)
    bad = {k for k, v in sites.items() if len(v) >= min_sites}
    out = []
    for i, t, lang, s in rows:
        if t is not None:
            lines = t.split("\n")
            kept = [x for x in lines if trim(x) not in bad]
            if any(map(trim, kept)):
                t = "\n".join(kept)
        out.append((i, t, lang, s, None if t is None else len(t)))
    return out


def corpus(seed, n=150):
    rng = random.Random(seed)
    common = [words(rng, 4) for _ in range(6)]
    rows = []
    for i in range(n):
        lines = [words(rng, 5) for _ in range(rng.randint(0, 5))] + rng.sample(common, rng.randint(0, 5)) + rng.choice([[], ["", "  "]])
        rng.shuffle(lines)
        rows.append((i, "\n".join(f" {x}\r" if rng.random() < 0.2 else x for x in lines), "en", f"site{rng.randint(0, 7 + i % 9)}"))
    return rows


def key(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_against_brute_force_and_sql(spark):
    for seed in range(3):
        rows = corpus(seed)
        got = key(L.remove_boilerplate(documents(spark, rows), 8).collect())
        assert got == key(brute(rows, 8)) and got != key((*r, len(r[1])) for r in rows)
        con = duckdb.connect()
        con.register("documents", pd.DataFrame([(*r, len(r[1])) for r in rows], columns=[x.split()[0] for x in DOCS.split(", ")]))
        assert key(con.execute(L.oracle_sql(8)).fetchall()) == got


def test_many_sites_near_the_threshold(spark):
    """Sketches decide far from it, exact counts near it."""
    rows = [(1000 * k + i, f"line {k}\nown {k} {i}", "en", f"site{i}") for k in (30, 39, 40, 41, 55) for i in range(k)]
    docs = documents(spark, rows)
    assert L.boilerplate(docs, 40).count() == 3
    assert key(L.remove_boilerplate(docs, 40).collect()) == key(brute(rows, 40))


def test_only_boilerplate_stays_whole(spark):
    """However much of a document is boilerplate it goes; only a document of nothing else stays."""
    body = [f"line {i} of a text that is copied" for i in range(6)]
    rows = [(100 * n + i, "\n".join(body[:n] + [f"own {n} {i}"]), "en", f"s{i}") for n in range(1, 7) for i in range(12)] + [(900 + i, "\n".join([*body, " \t"]), "en", f"s{i}") for i in range(12)]
    got = {r["doc_id"]: r["text"] for r in L.remove_boilerplate(documents(spark, rows)).collect()}
    assert all(got[100 * n + i] == f"own {n} {i}" for n in range(1, 7) for i in range(12))
    assert all(got[900 + i] == "\n".join([*body, " \t"]) for i in range(12))


def test_very_many_lines(spark):
    rows = [(i, f"shared\nown {i}.", "en", f"s{i}") for i in range(12)] + [(99, "\n".join(f"own {i}" if i % 5 == 0 else "shared" for i in range(60_000)), "en", "s0")]
    got = {r["doc_id"]: r["text"] for r in L.remove_boilerplate(documents(spark, rows)).collect()}
    assert got[99] == "\n".join(f"own {i}" for i in range(0, 60_000, 5)) and got[3] == "own 3."


def test_awkward(spark):
    rows = awkward(random.Random(5)) + [(200 + i, f"shared line\nown {i}\n", "en", f"w{i % 11}") for i in range(30)] + [(300, "shared line\nx y", "en", None)]
    docs = documents(spark, rows, clash=True)
    out = L.remove_boilerplate(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = out.collect()
    assert key((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in got) == key(brute(rows, L.MIN_SITES))
    assert all(r["drop"] == "own drop" for r in got)
    assert L.remove_boilerplate(docs.limit(0)).count() == 0
