"""Relevance by the distance between a query's words and runs of adjacent hits in a document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.plans.request import Terms

#: A local rank is coded as one character, so that the edit distance of sequences is that of strings. There are as many as code
#: points, less controls and surrogates: over a million.
_FIRST, _GAP = 33, range(0xD800, 0xE000)


def _char(rank: int) -> str:
    point = _FIRST + rank
    return chr(point if point < _GAP.start else point + len(_GAP))


def _coded(ranks: tuple[int, ...]) -> str:
    return "".join(map(_char, ranks))


def literal_map(table: dict, key: Column) -> Column:
    """table[key], null if it isn't there."""
    return F.element_at(F.map_from_arrays(F.lit(list(table)), F.lit(list(table.values()))), key)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once a row however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _score(terms: Terms, attr: str) -> Column:
    """The relevance of one attribute, from a hit's own positions; null if it has none."""
    vector = terms.ivec[attr]
    table = {t: _char(r) for (a, t), r in terms.local_rank().items() if a == attr}
    own = F.filter("indexes", lambda x: x["attr"] == attr)
    merged = F.array_sort(F.flatten(F.transform(own, lambda x: _let(literal_map(table, x["term"]), lambda c: F.transform(x["positions"], lambda p: F.struct(p.alias("pos"), c.alias("r")))))))

    def runs(m: Column) -> Column:  # a blank, which is no rank's character, before each hit that isn't next to the last one
        return F.split(F.array_join(F.transform(m, lambda x, i: F.when((i > 0) & (x["pos"] != F.get(m, i - 1)["pos"] + 1), F.concat(F.lit(" "), x["r"])).otherwise(x["r"])), ""), " ")

    def distances(d: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.length(d) - len(vector) + 1, F.lit(0)))
        return F.transform(places, lambda at: F.levenshtein(F.lit(_coded(vector)), F.substring(d, at + 1, F.lit(len(vector)))))

    def score(all_: Column, hits: Column) -> Column:
        return _let(F.array_min(all_), lambda least: (1 - least / len(vector)) * (F.size(F.filter(all_, lambda d: d == least)) / hits))

    return _let(merged, lambda m: F.when(F.size(m) > 0, _let(F.flatten(F.transform(runs(m), distances)), lambda all_: score(all_, F.size(m)))))


def scored(hits: DataFrame, terms: Terms, combine: str = "last") -> DataFrame:
    """hits that have a position of an attribute that counts, with relevance."""
    if combine not in ("last", "max", "mean"):
        raise ValueError(combine)
    attrs = list(terms.ivec)
    if not attrs:
        return hits.withColumn("relevance", F.lit(0.0)).where(F.lit(False))
    used = attrs[-1:] if combine == "last" else attrs
    scores = F.array_compact(F.array(*[_score(terms, a) for a in used]))
    joined = F.array_max(scores) if combine != "mean" else _let(scores, lambda s: F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s))
    some = F.exists("indexes", lambda x: x["attr"].isin(used) & (F.size(x["positions"]) > 0))
    return hits.where(some).withColumn("relevance", joined)


def relevance(hits: DataFrame, terms: Terms, combine: str = "last") -> DataFrame:
    """hits (ts, id, ..., indexes; each once) -> (ts, id, relevance).

    For an attribute with L words asked for, the hits' positions are merged and cut into runs of adjacent ones. Over each
    run slides a window of L, up to the first that is shorter. With the least edit distance d between the asked ranks and a
    window's, c windows at that distance and n hits in all: relevance = (1 - d / L) * c / n. With several attributes the last
    asked for counts; combine "max" or "mean" takes them all.

    A hit has all its positions, so this is of one row alone: neither a shuffle nor a join."""
    return scored(hits, terms, combine).select("ts", "id", "relevance")


def ranked(hits: DataFrame, terms: Terms, combine: str = "last", phrase: bool = False) -> DataFrame:
    """hits with relevance, most relevant first, ties by (ts, id). phrase keeps only documents with an exact run of the words."""
    out = scored(hits, terms, combine)
    if phrase:
        out = out.where(has_phrase(terms))
    return out.orderBy(F.desc("relevance"), "ts", "id")


def has_phrase(terms: Terms) -> Column:
    """Whether the words of every attribute stand next to each other in order somewhere in the document (column indexes)."""
    out = F.lit(True)
    local = terms.local_rank()
    for attr, vector in terms.ivec.items():
        by_rank = {r: t for (a, t), r in local.items() if a == attr}
        lists = [_positions(attr, by_rank[r]) for r in vector]
        out &= F.exists(lists[0], _followed(lists[1:]))
    return out


def _positions(attr: str, term: str) -> Column:
    return F.element_at(F.filter("indexes", lambda x: (x["attr"] == attr) & (x["term"] == term)), 1)["positions"]


def _followed(others: list[Column]) -> Callable[[Column], Column]:
    return lambda p: _all([F.array_contains(other, p + i) for i, other in enumerate(others, 1)])


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out &= c
    return out
