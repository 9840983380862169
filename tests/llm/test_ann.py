import math

import numpy as np
import pytest

from lexigrid.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r], 0) for i, r in zip(range(len(x)) if ids is None else ids, x)], SCHEMA)


def test_chi_square():
    for m in (2, 5, 8, 20):
        for p in (0.05, 0.5, 0.8, 0.99):
            assert ann.chi_square_cdf(ann.chi_square_quantile(p, m), m) == pytest.approx(p, abs=1e-9)
    assert ann.chi_square_cdf(3.0, 2) == pytest.approx(1 - math.exp(-1.5))


def test_split_covers_rows_and_descends_to_the_same_leaf():
    x = np.random.default_rng(0).integers(0, 4, (500, 3)).astype(float)
    nodes, leaves = ann.split(x, 20)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(500))
    leaf = ann.descend(nodes, x)
    for i, rows in enumerate(leaves):
        assert (leaf[rows] == i).all()
    assert len(ann.split(np.zeros((50, 3)), 5)[1]) == 1


@pytest.mark.parametrize("cell, every", [(60, 1), (100_000, 1), (60, 50), (100, 7)])
def test_recall_against_brute_force(spark, cell, every):
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((12, 24)) * 2
    x = (centers[rng.integers(0, 12, 700)] + rng.standard_normal((700, 24))).astype(np.float32).astype(float)
    got: dict[int, list] = {}
    for r in ann.nearest(frame(spark, x), k=10, cell=cell, every=every).collect():
        got.setdefault(r["vec_id"], []).append((r["rank"], r["neighbor_id"], r["distance"]))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    hit, asked = 0, range(0, 700, every)
    assert sorted(got) == list(asked)
    for i in asked:
        assert [r for r, _, _ in sorted(got[i])] == list(range(1, 11))
        hit += len({j for _, j, _ in got[i]} & set(np.argsort(d[i])[:10].tolist()))
        assert all(abs(d[i, j] - v) < 1e-6 for _, j, v in got[i])
    assert hit / (10 * len(asked)) >= 0.9


def test_search_verifies_few_and_finds_them():
    """Clustered vectors: the stopping test leaves most of them unverified."""
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((40, 64)) * 3
    x = centers[rng.integers(0, 40, 8000)] + rng.standard_normal((8000, 64)) * 0.5
    projection = rng.standard_normal((64, ann.DIMENSIONS))
    tree = ann.Tree(np.arange(8000), x, projection)
    ask = np.arange(0, 8000, 50)
    who, best = tree.search(ask, x[ask], 10, ann.chi_square_quantile(ann.CONFIDENCE, ann.DIMENSIONS) / ann.RATIO**2)
    d = ((x[ask, None] - x[None]) ** 2).sum(-1)
    d[np.arange(len(ask)), ask] = np.inf
    near = np.argsort(d, axis=1)[:, :10]
    assert np.mean([len({*a} & {*b}) / 10 for a, b in zip(who.tolist(), near.tolist())]) >= 0.9
    assert tree.verified < 0.3 * 8000 * len(ask)
    assert np.allclose(np.take_along_axis(d, who, 1), best)


def test_awkward(spark):
    rows = [(1, [0.0, 0.0], 0), (2, [0.0, 0.0], 0), (3, [3.0, 4.0], 0), (3, [3.0, 4.0], 0), (4, None, 0), (5, [], 0), (6, [1.0], 0), (7, [1.0, None], 0), (8, [1.0, float("nan")], 0), (None, [0.0, 1.0], 0), (9, [3.0, 5.0], 0), (9, [9.0, 9.0], 0)]
    got = [(r["vec_id"], r["rank"], r["neighbor_id"], r["distance"]) for r in ann.nearest(spark.createDataFrame(rows, SCHEMA), k=2).collect()]
    assert sorted(got) == [(1, 1, 2, 0.0), (1, 2, 3, 5.0), (2, 1, 1, 0.0), (2, 2, 3, 5.0), (3, 1, 9, 1.0), (3, 2, 1, 5.0), (9, 1, 3, 1.0), (9, 2, 1, pytest.approx(math.sqrt(34)))]
    clashing = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'own' AS id", "'own' AS v", "'own' AS cell", "'own' AS who", "'own' AS rank")
    assert sorted(map(tuple, ann.nearest(clashing, k=2).collect())) == sorted(got)
    assert ann.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert ann.nearest(spark.createDataFrame(rows[:1], SCHEMA)).count() == 0


def test_many_equal_vectors(spark):
    got = ann.nearest(frame(spark, np.ones((300, 4))), k=3, cell=50).collect()
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r["neighbor_id"])
        assert r["distance"] == 0
    assert sorted(by[5]) == [0, 1, 2] and sorted(by[0]) == [1, 2, 3]
