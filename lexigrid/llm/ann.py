"""Nearest neighbours by stable random projections in a kd-tree (after SRS, Sun et al. 2014).

Vectors are projected by a Gaussian matrix to a few dimensions. For two vectors at distance d the squared distance of their
projections is d**2 times a chi-square variable. A kd-tree over the projections gives ever farther leaves; a leaf's vectors
are verified by their true distances, and the search of a query ends when the next leaf is so far that a vector at the
present k-th distance, divided by RATIO, would have been met before it with probability CONFIDENCE.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import saved

K = 10
DIMENSIONS = 8
CONFIDENCE = 0.95
#: With probability CONFIDENCE a found k-th distance is at most so many times the true one.
RATIO = 1.05
#: Vectors of a cell (one task's tree), as a mean; cells grow beyond MAX_CELLS, whose boxes (128 bytes each) every task holds.
CELL = 8192
MAX_CELLS = 200_000
LEAF = 32
#: Queries and leaves that are verified by one product.
_QUERIES, _LEAVES = 16, 8
#: Queries times cells whose distances are held at once.
_REACH = 1 << 22
#: Rows that place the cells' borders. They are layout alone: boxes are those of all rows, and every row is searched.
BORDER_ROWS = 65_536
SEED = 7


def chi_square_cdf(x: float, m: int) -> float:
    """The regularized lower incomplete gamma function at m/2, x/2, by its series."""
    if x <= 0:
        return 0.0
    a, z = m / 2, x / 2
    if z > a + 40 * math.sqrt(a) + 40:
        return 1.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(a * math.log(z) - z - math.lgamma(a)))


def chi_square_quantile(p: float, m: int) -> float:
    low, high = 0.0, 1.0
    while chi_square_cdf(high, m) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, m) < p else (low, mid)
    return high


def split(points: np.ndarray, leaf: int) -> tuple[list[tuple[int, float, int, int]], list[np.ndarray]]:
    """A kd-tree: inner nodes (dimension, border, left, right), children below 0 being leaves -1 - i; and the leaves' rows.
    A node is cut at the median of its widest dimension; rows equal in all dimensions stay together."""
    nodes: list[tuple[int, float, int, int]] = []
    leaves: list[np.ndarray] = []
    todo = [(np.arange(len(points)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        own = points[rows]
        d = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if len(rows) else 0
        border = float(np.median(own[:, d])) if len(rows) else 0.0
        left = own[:, d] < border if len(rows) else np.zeros(0, bool)
        if len(rows) and not left.any():
            left = own[:, d] <= border
        if len(rows) <= leaf or left.all() or not left.any():
            at = -1 - len(leaves)
            leaves.append(rows)
        else:
            at = len(nodes)
            if not (own[:, d] < border).any():
                border = float(np.nextafter(border, np.inf))
            nodes.append((d, border, 0, 0))
            todo += [(rows[~left], at, 3), (rows[left], at, 2)]
        if parent >= 0:
            node = list(nodes[parent])
            node[side] = at
            nodes[parent] = tuple(node)
    return nodes, leaves


def descend(nodes: list[tuple[int, float, int, int]], points: np.ndarray) -> np.ndarray:
    """The leaf of each point."""
    at = np.full(len(points), 0 if nodes else -1)
    if not nodes:
        return np.zeros(len(points), np.int32)
    dim = np.array([n[0] for n in nodes])
    border = np.array([n[1] for n in nodes])
    child = np.array([n[2:] for n in nodes])
    while (open_ := np.flatnonzero(at >= 0)).size:
        n = at[open_]
        at[open_] = child[n, (points[open_, dim[n]] >= border[n]).astype(int)]
    return (-1 - at).astype(np.int32)


def box_distances(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point from each box."""
    out = np.zeros((len(q), len(low)))
    for d in range(q.shape[1]):
        x = q[:, d, None]
        gap = np.maximum(low[None, :, d] - x, 0) + np.maximum(x - high[None, :, d], 0)
        out += gap * gap
    return out


class Tree:
    """Vectors of one cell, in a kd-tree over their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projection: np.ndarray, leaf: int = LEAF) -> None:
        self.projection = projection
        p = vectors @ projection
        _, leaves = split(p, leaf)
        leaves = [r[np.argsort(ids[r], kind="stable")] for r in leaves if len(r)]
        self.low = np.array([p[r].min(axis=0) for r in leaves])
        self.high = np.array([p[r].max(axis=0) for r in leaves])
        order = np.concatenate(leaves)
        self.ids, self.vectors = ids[order], vectors[order]
        self.start = np.concatenate([[0], np.cumsum([len(r) for r in leaves])])
        # (-2x, |x|^2, 1) by (q, 1, |q|^2) gives squared distances by one product, in single precision.
        own = (self.vectors * self.vectors).sum(axis=1)
        self.rough = np.column_stack([-2 * self.vectors, own, np.ones(len(own))]).astype(np.float32)
        self.largest = float(own.max(initial=0))
        self.verified = 0

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int, factor: float, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, squared distances) of each query's k nearest here, by (distance, id), filled up with (-1, inf); without the
        query's own id. bound: squared distances beyond which nothing is wanted."""
        n = len(q)
        best = np.full((n, k), np.inf)
        who = np.full((n, k), -1, np.int64)
        p = q @ self.projection
        # Queries that begin in the same leaf stand together, so that they visit the same leaves.
        near = np.concatenate([box_distances(p[a : a + 1024], self.low, self.high).argmin(axis=1) for a in range(0, n, 1024)]) if n else np.zeros(0, int)
        turn = np.argsort(near, kind="stable")
        for a in range(0, n, _QUERIES):
            part = turn[a : a + _QUERIES]
            b, w = best[part], who[part]
            self._search(q_ids[part], q[part], p[part], k, factor, np.full(len(part), np.inf) if bound is None else bound[part], b, w)
            best[part], who[part] = b, w
        return who, best

    def _search(self, q_ids, q, p, k, factor, bound, best, who) -> None:
        """Some queries at a time, so that a leaf's vectors are verified for all of them by one product of matrices. Leaves
        come in the order of their least distance from any of the queries, and are skipped where every query's search has
        ended; each query's test is its own."""
        far = box_distances(p, self.low, self.high)
        order = np.argsort(far.min(axis=0), kind="stable")
        own = (q * q).sum(axis=1)
        asked = np.column_stack([q, np.ones(len(q)), own]).astype(np.float32)
        slack = (4e-6 * (own + self.largest)).astype(np.float32)  # rounding of the product; what passes is measured again
        for at in range(0, len(order), _LEAVES):
            leaves = order[at : at + _LEAVES]
            # The stopping test: a vector within the k-th distance would lie beyond this leaf's distance too rarely.
            worst = np.minimum(best[:, k - 1], bound)
            leaves = leaves[(far[:, leaves] <= factor * worst[:, None]).any(axis=0)]
            if not len(leaves):
                continue
            rows = np.concatenate([np.arange(self.start[x], self.start[x + 1]) for x in leaves])
            self.verified += len(rows) * len(q)
            rough = asked @ self.rough[rows].T
            limit = (worst + slack).astype(np.float32)
            if np.isinf(limit).any():  # at first everything passes: keep what can be among the k nearest of these leaves
                m = min(k, rough.shape[1] - 1)  # one more than k, as the query itself may be here
                limit = np.minimum(limit, np.partition(rough, m, axis=1)[:, m] + 2 * slack)
            i, j = np.nonzero(rough <= limit[:, None])
            x, ids = self.vectors[rows[j]], self.ids[rows[j]]
            diff = x - q[i]
            d = (diff * diff).sum(axis=1)
            ok = (d <= worst[i]) & (ids != q_ids[i])
            i, d, ids = i[ok], d[ok], ids[ok]
            if not len(i):
                continue
            some = np.unique(i)
            row = np.concatenate([np.repeat(some, k), i])
            dist, name = np.concatenate([best[some].ravel(), d]), np.concatenate([who[some].ravel(), ids])
            sort = np.lexsort((name, dist, row))
            row, dist, name = row[sort], dist[sort], name[sort]
            first = np.searchsorted(row, some)[:, None] + np.arange(k)[None, :]
            best[some], who[some] = dist[first], name[first]


def _array(column: pd.Series, dim: int) -> np.ndarray:
    return np.concatenate(column.tolist()).reshape(-1, dim).astype(np.float64) if len(column) else np.zeros((0, dim))


def nearest(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K, dimensions: int = DIMENSIONS, confidence: float = CONFIDENCE, ratio: float = RATIO, cell: int = CELL, seed: int = SEED, every: int = 1
) -> DataFrame:
    """(vec_id, rank, neighbor_id, distance): for queries the k nearest others among all vectors by Euclidean distance,
    approximately. Queries are the vectors whose id is divisible by `every`, so all of them for 1.

    A top kd-tree parts the vectors into cells. A cell's queries search their own cell; every other cell whose box lies
    within the stopping test's reach is then searched with the distance found as a bound, and the results merged. With
    probability `confidence` or more a k-th distance found is at most `ratio` times the true one.

    Nulls: rows with a null id or vector, a null or not finite component, or another length than most vectors have are
    left out. Empty vectors likewise. Ties in distance go by id. Of rows with the same id the one with the least vector
    counts, so repeated rows are one. Fewer than k others give fewer rows. An empty table gives an empty result. Other
    columns aren't read.
    """
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), v.alias("v")).where("id IS NOT NULL AND size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    rows = saved(rows.select("id", F.col("v").cast("array<float>").alias("v")), "vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return rows.select(F.col("id").alias("vec_id"), F.lit(1).alias("rank"), F.col("id").alias("neighbor_id"), F.lit(0.0).alias("distance"))
    dim, n = sizes["d"], sizes["count"]
    rows = rows.where(F.size("v") == dim)
    projection = np.random.default_rng(seed).standard_normal((dim, dimensions))
    factor = chi_square_quantile(confidence, dimensions) / ratio**2
    cell = max(cell, -(-n // MAX_CELLS))
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // BORDER_ROWS))) == 0).toArrow() if n > cell else None
    nodes = []
    if some is not None and some.num_rows:
        border_points = np.concatenate(some["v"].to_pylist()).reshape(-1, dim) @ projection
        nodes, _ = split(border_points, max(1, int(cell * len(border_points) / n)))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = _array(pdf["v"], dim) @ projection
            pdf["cell"] = descend(nodes, p)
            for d in range(dimensions):
                pdf[f"p{d}"] = p[:, d]
            yield pdf

    placed = saved(rows.mapInPandas(assign, "id bigint, v array<float>, cell int, " + ", ".join(f"p{d} double" for d in range(dimensions))), "cells")
    boxes = placed.groupBy("cell").agg(*[f(f"p{d}").alias(f"{f.__name__}{d}") for f in (F.min, F.max) for d in range(dimensions)]).toPandas()
    numbers = boxes["cell"].to_numpy()
    low, high = boxes[[f"min{d}" for d in range(dimensions)]].to_numpy(), boxes[[f"max{d}" for d in range(dimensions)]].to_numpy()
    data = placed.select("cell", "id", "v")

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, here = pdf["id"].to_numpy(), pdf["cell"].iloc[0]
        ask = np.flatnonzero(ids % every == 0)
        if not len(ask):
            none = pd.Series([], dtype=object)
            return pd.DataFrame({"id": ids[:0], "v": none, "bound": np.zeros(0), "who": none, "best": none, "targets": none})
        x = _array(pdf["v"], dim)
        who, best = Tree(ids, x, projection).search(ids[ask], x[ask], k, factor)
        p, step, targets = x[ask] @ projection, max(1, _REACH // len(numbers)), []
        for a in range(0, len(ask), step):
            reach = box_distances(p[a : a + step], low, high) <= factor * best[a : a + step, -1:]
            reach[:, numbers == here] = False
            targets += [numbers[r] for r in reach]
        return pd.DataFrame({"id": ids[ask], "v": pdf["v"].iloc[ask].to_numpy(), "bound": best[:, -1], "who": list(who), "best": list(best), "targets": pd.Series(targets, dtype=object)})

    first = saved(data.groupBy("cell").applyInPandas(own, "id bigint, v array<float>, bound double, who array<bigint>, best array<double>, targets array<int>"), "own-cells")
    guests = first.select("id", "v", "bound", F.explode("targets").alias("cell"))

    def lists(ids: np.ndarray, who: list, best: list) -> pd.DataFrame:
        return pd.DataFrame({"id": ids, "who": pd.Series(who, dtype=object), "best": pd.Series(best, dtype=object)})

    def visit(guests: pd.DataFrame, hosts: pd.DataFrame) -> pd.DataFrame:
        if not len(guests) or not len(hosts):
            return lists(np.zeros(0, np.int64), [], [])
        tree = Tree(hosts["id"].to_numpy(), _array(hosts["v"], dim), projection)
        who, best = tree.search(guests["id"].to_numpy(), _array(guests["v"], dim), k, factor, guests["bound"].to_numpy())
        some = np.isfinite(best[:, 0])
        return lists(guests["id"].to_numpy()[some], list(who[some]), list(best[some]))

    second = guests.groupBy("cell").cogroup(data.groupBy("cell")).applyInPandas(visit, "id bigint, who array<bigint>, best array<double>")
    found = first.select("id", "who", "best").unionByName(second).select("id", F.zip_with("best", "who", lambda b, w: F.struct(b.alias("d"), w.alias("w"))).alias("c"))
    # Lists of at most k: a query's are as many as the cells that it visited.
    merged = found.groupBy("id").agg(F.slice(F.array_sort(F.filter(F.flatten(F.collect_list("c")), lambda c: c["d"] < float("inf"))), 1, k).alias("c"))
    return merged.select(F.col("id").alias("vec_id"), F.posexplode("c").alias("at", "c")).select("vec_id", (F.col("at") + 1).alias("rank"), F.col("c.w").alias("neighbor_id"), F.sqrt("c.d").alias("distance"))
