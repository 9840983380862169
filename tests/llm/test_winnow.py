import random

import numpy as np
import pytest

from lexigrid.llm import winnow as W

from .helpers import awkward, documents, words


def brute(text, noise, window):
    """By the book: a window slides over all k-grams; its rightmost least is kept."""
    from lexigrid.llm.common import Powers

    kept = [(i, c) for i, c in enumerate(text or "") for c in [c.lower() if len(c.lower()) == 1 else c] if c.isalnum()]
    points = np.array([ord(c) for _, c in kept], np.uint32)
    grams = [int(Powers().spans(points[i : i + noise], np.array([0]), np.array([noise]))[0]) for i in range(len(points) - noise + 1)]
    out = {}
    for a in range(max(1, len(grams) - window + 1) if grams else 0):
        own = grams[a : a + window]
        at = max(i for i, h in enumerate(own) if h == min(own)) + a
        out[kept[at][0]] = grams[at]
    return sorted(out.items())


def pairs(found):
    return [(int(p), int(h) % 2**64) for p, h in zip(*found)]


@pytest.mark.parametrize("noise,window", [(5, 4), (1, 1), (3, 7), (24, 41)])
def test_against_brute_force(noise, window):
    rng = random.Random(noise)
    texts = [words(rng, rng.randint(0, 60), "abİß é,") for _ in range(30)] + [None, "", "a", "aaaaaaaaaaaaaaaaaaaa", "ab" * 40]
    for t, f in zip(texts, W.fingerprints(texts, noise, window)):
        assert pairs(f) == brute(t, noise, window)


def test_rightmost_ties():
    h = np.array([5, 1, 1, 7, 1, 9, 9], np.uint64)
    assert W.rightmost_minima(h, 3).tolist() == [2, 2, 4, 4, 4]


def test_guarantee():
    rng = random.Random(9)
    shared = words(rng, 30)
    n = sum(c.isalnum() for c in shared)
    assert n >= W.NOISE + W.WINDOW - 1
    a, b = W.fingerprints([words(rng, 40) + " " + shared.upper(), shared + ". " + words(rng, 50)])
    assert set(a[1].tolist()) & set(b[1].tolist())
    x, y = W.fingerprints([words(rng, 80), words(rng, 80)])
    assert not set(x[1].tolist()) & set(y[1].tolist())


def test_query(spark):
    rows = awkward(random.Random(3))
    docs = documents(spark, rows, clash=True)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["positions"], [h % 2**64 for h in r["hashes"]]) for r in W.winnow(docs, 5, 4).collect()), key=str)
    want = []
    for (i, t, *_), f in zip(rows, W.fingerprints([r[1] for r in rows], 5, 4)):
        want.append((i is None, i or 0, f[0].tolist(), [int(h) % 2**64 for h in f[1]]))
    assert got == sorted(want, key=str)
    assert W.winnow(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        W.winnow(docs, 0)
