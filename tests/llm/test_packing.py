import random

import numpy as np
import pytest

import corpus_pipeline
from lexigrid.llm import packing, registry, token_store

from .helpers import awkward, documents

CAP = (100, 4, 4000)


def brute(lengths, cap, weights, method):
    bins, out = [], []
    for n in lengths:
        item = (n, 1, n * n)
        best = None
        for b, r in enumerate(bins):
            if all(x >= y for x, y in zip(r, item)):
                score = sum(w * ((x - y) / c) ** 2 for w, x, y, c in zip(weights, r, item, cap)) if method == "norm" else -sum(w * x * y / c / c for w, x, y, c in zip(weights, r, item, cap))
                if best is None or score < best[0] - 1e-12:
                    best = (score, b)
        if best is None:
            bins.append(list(cap))
            best = (0, len(bins) - 1)
        bins[best[1]] = [x - y for x, y in zip(bins[best[1]], item)]
        out.append(best[1])
    return out


@pytest.mark.parametrize("method", ["norm", "dot"])
def test_best_fit_against_brute_force(method):
    rng = random.Random(4)
    for _ in range(20):
        lengths = sorted((rng.randint(1, 60) for _ in range(rng.randint(1, 80))), reverse=True)
        assert packing.best_fit(np.array(lengths), CAP, (1.0, 0.1, 0.3), method).tolist() == brute(lengths, CAP, (1.0, 0.1, 0.3), method)
    assert len(packing.best_fit(np.zeros(0, int), CAP)) == 0


def test_every_token_once_within_capacity(spark):
    rows = awkward(random.Random(5))
    out = packing.pack(documents(spark, rows, clash=True), 100, 4, 4000, 50).collect()
    bins: dict[int, list] = {}
    parts: dict = {}
    for r in out:
        bins.setdefault(r["bin_id"], []).append(r)
        parts.setdefault(r["doc_id"], []).append((r["start_token"], r["n_tokens"]))
    for b in bins.values():
        n = [r["n_tokens"] for r in b]
        assert sum(n) <= 100 and len(n) <= 4 and sum(x * x for x in n) <= 4000 and sorted(r["slot"] for r in b) == list(range(len(b)))
    want: dict = {}
    for i, t, *_ in rows:
        n = len((t or "").split())
        if n:
            want.setdefault(i, []).append(n)
    assert parts.keys() == want.keys()
    for i, sizes in want.items():
        assert sum(n for _, n in parts[i]) == sum(sizes)
        if len(sizes) == 1:
            assert sorted(parts[i]) == [(s, min(50, sizes[0] - s)) for s in range(0, sizes[0], 50)]


def test_groups_as_brute_force(spark):
    rng = random.Random(6)
    docs = documents(spark, [(i, "w " * rng.randint(1, 50), "en", "s") for i in range(300)])
    out = sorted(packing.pack(docs, 100, 4, 4000, 50).collect(), key=lambda r: (-r["n_tokens"], r["doc_id"]))
    assert [r["bin_id"] for r in out] == brute([r["n_tokens"] for r in out], CAP, packing.WEIGHTS, "norm")


@pytest.mark.parametrize("group", [40, 299, 300])
def test_several_groups(spark, group):
    """Above the bound a group is best fit for itself; at the bound there is one, over all bins. Rows alike are spread too."""
    rng = random.Random(6)
    docs = documents(spark, [(i, "w " * rng.randint(1, 50), "en", "s") for i in range(200)] + [(None, "w " * 20, "en", "s")] * 60 + [(7, "w " * 30, "en", "s")] * 40)
    out = packing.pack(docs, 100, 4, 4000, 50, group_pieces=group).collect()
    groups: dict[int, list] = {}
    for r in out:
        groups.setdefault(r["bin_id"] >> 32, []).append(r)
    assert len(out) == 300 and len(groups) == -(-300 // group) and sum(r["doc_id"] is None for r in out) == 60
    for g in groups.values():
        g.sort(key=lambda r: (-r["n_tokens"], r["doc_id"] is not None, r["doc_id"] or 0))
        want = sorted(brute([r["n_tokens"] for r in g], CAP, packing.WEIGHTS, "norm"))
        assert sorted(r["bin_id"] & 0xFFFFFFFF for r in g) == want
        if group == 40:
            assert 0 < sum(r["doc_id"] is None for r in g) < 40


def test_limits(spark):
    docs = documents(spark, [])
    assert packing.pack(docs).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, 100, 4, 400, 50)
    with pytest.raises(ValueError):
        packing.pack(docs, group_pieces=0)


def test_tokens_are_ids(spark, tmp_path):
    """Texts without blanks have tokens by their length: op4 and the pipeline count the tokenizer's ids."""
    texts = ["\u65e5\u672c\u8a9e" * 2400, "QWxhZGRpbjpvcGVu" * 1250, "some plain words", "", None]
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    encode, id_bytes = token_store.tokenizer(token_store.TOKENIZER)
    ids = {i: len(encode([t])[0]) // id_bytes for i, t in enumerate(texts) if t}
    total = lambda df: {r[0]: r[1] for r in df.groupBy("doc_id").sum("n_tokens").collect()}
    out = registry.op4_best_fit_packing(spark, str(tmp_path))
    assert total(out) == ids and ids[0] > 2 * packing.MAX_PIECE
    assert out.selectExpr("max(n_tokens)").first()[0] <= packing.MAX_PIECE
    assert total(corpus_pipeline.packed(spark, docs, "")) == ids
