import math
import random
from collections import Counter

import numpy as np
import pytest

from lexigrid.llm import quality as Q
from lexigrid.llm.lookup import Lookup

from .helpers import awkward, documents, words

LABELS = "doc_id bigint, quality int, toxic int"


def brute_model(texts, order):
    """p(context, byte) by the book, from strings."""
    raw = Counter()
    for t in texts:
        b = b"\0" * (order - 1) + t.encode()
        for i in range(len(b) - order + 1):
            raw[b[i : i + order]] += 1
    counts = {order: raw}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d = {k: Q.discounts(Counter(c.values())) for k, c in counts.items()}

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / 256
        own = {x: c for x, c in counts[k].items() if x[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        cut = lambda c: d[k][min(c, 3) - 1]
        total = sum(own.values())
        c = counts[k].get(g, 0)
        return (max(c - cut(c), 0) if c else 0) / total + sum(map(cut, own.values())) / total * p(g[1:])

    return p


def test_model_against_brute_force(spark):
    rng = random.Random(1)
    texts = [words(rng, 12, "abc") for _ in range(12)] + ["é ab", ""]
    p = brute_model(texts, 4)
    g, _ = Q.grams([t.encode() for t in texts], 4)
    new, _ = Q.grams([b"abz zab xyz cab"], 4)
    c = Counter(g.tolist())
    half = Counter({x: n for x, n in c.items() if x % 3})
    rows = [(0, x, c.get(x, 0), True) for x in {*c, *new.tolist()}] + [(1, x, n, x in new.tolist()) for x, n in half.items()]
    out = Q.kneser_ney(spark.createDataFrame(rows, "m int, g bigint, c bigint, asked boolean"), 4).collect()
    assert {r["g"] for r in out if r["m"] == 1} == {*half} & {*new.tolist()}
    got = {r["g"]: r["p"] for r in out if r["m"] == 0}
    assert got.keys() == {*c, *new.tolist()}
    for x, v in got.items():
        assert v == pytest.approx(p(x.to_bytes(4, "big")), rel=1e-9)
    some = next(iter(c)).to_bytes(4, "big")[:-1]
    assert sum(p(some + bytes([b])) for b in range(256)) == pytest.approx(1)


def test_lookup():
    keys = np.random.default_rng(0).choice(2**40, 5000, replace=False)
    found = Lookup(keys, np.arange(5000.0), default=-1.0)
    assert (found.get(keys) == np.arange(5000)).all() and (found.get(np.array([2**41, 2**42])) == -1).all()
    assert Lookup(keys[:0], np.zeros(0)).get(keys[:2]).tolist() == [0, 0]


GOOD, LABELLED, ALL = 280, 200, 320


def corpus(spark, clash=False):
    """280 good documents, 200 of them labelled so, and 40 bad ones."""
    rng = random.Random(2)
    vocabulary = words(rng, 60, "abcdefg").split()
    rows = [(i, " ".join(rng.choices(vocabulary, k=30)) if i < GOOD else words(rng, 30, "xyzw!"), "en", "s") for i in range(ALL)]
    labels = spark.createDataFrame([(i, 1 if i < LABELLED else 0, 0) for i in range(ALL) if not LABELLED <= i < GOOD] + [(0, 1, 0)], LABELS)
    return rows, documents(spark, rows, clash), labels


def folds(spark, n=1000):
    return {r["id"]: r["f"] for r in spark.range(n).selectExpr("id", f"pmod(xxhash64(id), {Q.FOLDS}) AS f").collect()}


def brute_nll(p, text, seen):
    b = b"\0" * (Q.ORDER - 1) + text.encode()
    grams = [b[j : j + Q.ORDER] for j in range(len(text.encode()))]
    for g in grams:
        if g not in seen:
            seen[g] = -math.log2(p(g))
    return sum(seen[g] for g in grams) / len(grams)


def brute_cut(rows, trusted, fold, lang, quantile):
    """The least of a language's cross-validated scores with at least that share of them not above it."""
    scores = []
    for k in range(Q.FOLDS):
        own = [t for i, t, l, *_ in rows if i in trusted and t and fold[i] == k and l == lang]
        p, seen = brute_model([t for i, t, *_ in rows if i in trusted and t and fold[i] != k], Q.ORDER) if own else None, {}
        scores += [brute_nll(p, t, seen) for t in own]
    return np.quantile(scores, quantile, method="inverted_cdf")


@pytest.mark.parametrize("limit", [Q.BROADCAST_GRAMS, 0])
def test_classify(spark, limit):
    rows, docs, labels = corpus(spark)
    got = {r["doc_id"]: r for r in Q.classify(docs, labels, 0.9, limit).collect()}
    p, seen = brute_model([t for i, t, *_ in rows if i < LABELLED], Q.ORDER), {}
    for i, t, *_ in rows[::29]:
        assert math.log2(got[i]["perplexity"]) == pytest.approx(brute_nll(p, t, seen), rel=1e-9)
        assert got[i]["keep"] == (got[i]["perplexity"] <= got[i]["threshold"])
    assert math.log2(got[0]["threshold"]) == pytest.approx(brute_cut(rows, set(range(LABELLED)), folds(spark), "en", 0.9))
    kept = Q.keep_good(docs, labels, 0.9, limit)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in got.items() if r["keep"])


def test_held_out_accuracy(spark):
    """Documents that neither the model nor the thresholds saw."""
    rows, docs, labels = corpus(spark)
    got = {r["doc_id"]: r["keep"] for r in Q.classify(docs, labels).collect()}
    assert sum(got[i] for i in range(LABELLED, GOOD)) / (GOOD - LABELLED) >= 0.95
    assert not any(got[i] for i in range(GOOD, ALL))


def test_awkward(spark):
    rows = awkward(random.Random(7))
    docs = documents(spark, rows, clash=True)
    labels = spark.createDataFrame([(i, 1, None) for i in range(25)] + [(None, 1, 0), (26, 1, 1), (27, None, 0)], LABELS)
    for limit in (Q.BROADCAST_GRAMS, 0):
        out = Q.classify(docs, labels, broadcast_grams=limit).collect()
        assert len(out) == len(rows)
        by = {r["doc_id"]: r for r in out}
        assert by[100]["perplexity"] is None and not by[100]["keep"] and not by[101]["keep"] and by[103]["perplexity"] > 1
        assert by[107]["n_bytes"] == len(rows[-3][1].encode())
        kept = Q.keep_good(docs, labels, broadcast_grams=limit)
        assert kept.columns == docs.columns and kept.count() == sum(r["keep"] for r in out)
        assert kept.first()["nll"] == "own nll"
    assert all(r["keep"] for r in Q.classify(docs.where("text != ''"), labels.limit(0)).collect())
    assert Q.classify(docs.limit(0), labels).count() == 0 and Q.keep_good(docs.limit(0), labels).count() == 0
    assert Q.discounts({}) == (0.5, 0.75, 0.9)


def test_ids_joined_by_shuffle(spark, monkeypatch):
    _, docs, labels = corpus(spark)
    want = sorted(map(tuple, Q.classify(docs, labels).collect()))
    monkeypatch.setattr(Q, "BROADCAST_IDS", 0)
    monkeypatch.setattr(Q, "BROADCAST_LANGS", 0)
    assert [r[:3] for r in sorted(map(tuple, Q.classify(docs, labels).collect()))] == [r[:3] for r in want]


def test_small_and_unlabelled_languages(spark):
    """A language with few trusted documents has its own cross-validated threshold; one with none isn't judged."""
    rng = random.Random(8)
    en, es, pt = (words(rng, k, a).split() for k, a in ((20, "abcd"), (60, "efghijkl"), (60, "mnopqrst")))
    text = lambda v: " ".join(rng.choices(v, k=12))
    rows = [(i, text(en), "en", "s") for i in range(150)] + [(200 + i, text(es), "es", "s") for i in range(60)] + [(300 + i, text(pt), "pt", "s") for i in range(20)] + [(400 + i, words(rng, 12, "xyzw!"), "es", "s") for i in range(5)]
    trusted = {*range(140), *range(200, 230)}
    labels = spark.createDataFrame([(i, 1, 0) for i in sorted(trusted)] + [(400, 0, 0)], LABELS)
    docs = documents(spark, rows)
    got = {r["doc_id"]: r for r in Q.classify(docs, labels, Q.QUANTILE).collect()}
    assert all(got[i]["keep"] and got[i]["threshold"] is None for i in range(300, 320))
    assert sum(got[i]["keep"] for i in range(230, 260)) > 15 and not any(got[i]["keep"] for i in range(400, 405))
    fold = folds(spark)
    for i, lang in ((0, "en"), (200, "es")):
        assert math.log2(got[i]["threshold"]) == pytest.approx(brute_cut(rows, trusted, fold, lang, Q.QUANTILE), rel=1e-9)
    kept = Q.keep_good(docs, labels, Q.QUANTILE)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in got.items() if r["keep"])


def test_thresholds_are_made_alike_at_every_size(spark):
    """With one trusted document or many: each is scored by a model of the other folds."""
    rng = random.Random(9)
    sizes, rows = {"en": 30, "de": 1, "fr": 2, "es": 19, "pt": 20, "it": 21}, []
    for lang, n in sizes.items():
        rows += [(len(rows) + i, words(rng, 15, "abcd"), lang, "s") for i in range(n)]
    trusted = {r[0] for r in rows}
    rows += [(500 + i, words(rng, 15, "abcd"), lang, "s") for i, lang in enumerate(sizes)]
    labels = spark.createDataFrame([(i, 1, 0) for i in sorted(trusted)], LABELS)
    cut = {r["lang"]: r["threshold"] for r in Q.classify(documents(spark, rows), labels, 0.9).collect()}
    for lang in sizes:
        assert math.log2(cut[lang]) == pytest.approx(brute_cut(rows, trusted, folds(spark), lang, 0.9), rel=1e-9)
