"""Quality classifier: an interpolated modified Kneser-Ney model of byte n-grams, trained on the trusted documents.

The unit is the byte of UTF-8, so that the alphabet is 256 for every language and script, an n-gram of ORDER bytes is an
exact 40-bit integer, and nothing is out of vocabulary. Counts are kept as distributed tables and looked up by joins on
the n-gram, its context and its suffix; only the joined result of the n-grams that occur is brought to the documents.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm.common import chunks, packed, saved, small_batches
from lexigrid.llm.lookup import Lookup

ORDER = 5
#: A language's threshold is this quantile of the perplexities of its trusted documents, each under a model of the other folds.
QUANTILE = 0.995
#: Folds of the trusted documents, by hash of doc_id: a model finds its own training text too easy, so that thresholds taken
#: from that would reject good documents.
FOLDS = 5
#: Ranks that a quantile is exact to, of all of a language's trusted documents; below so many it is exact.
RANKS = 100_000
#: Rows of the scored n-gram table that are broadcast at most (16 bytes each); above, texts are shuffled to them by block.
BROADCAST_GRAMS = 4_000_000
#: doc_ids of trusted documents that are broadcast at most; above, they are joined by shuffle.
BROADCAST_IDS = 4_000_000
#: Languages whose thresholds are broadcast at most; above, they are joined by shuffle. Few languages hold most texts, so that
#: a shuffle on them would send the texts to few tasks.
BROADCAST_LANGS = 1_000_000
#: Bytes of text of a block where texts are shuffled, as a mean; a longer text is a block's alone, whole.
BLOCK_BYTES = 32 << 20


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the texts, each text preceded by order-1 zero bytes; and each text's number of bytes."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    pad = b"\0" * (order - 1)
    joined = np.frombuffer(pad + pad.join(texts), np.uint8)
    n = len(joined) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64), sizes
    g = np.zeros(n, np.int64)
    for i in range(order):
        g <<= 8
        g |= joined[i : i + n]
    # The n-gram at i ends at byte i + order - 1. After each text stand order - 1 bytes of padding: what ends there is of no text.
    keep = np.ones(n, bool)
    after = np.cumsum(sizes + order - 1)[:-1]
    keep[(after[:, None] - order + 1 + np.arange(order - 1)).ravel()] = False
    return g[keep], sizes


def _count(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(text, fold) -> (fold, g, c): every n-gram of the partition, and how often it occurs in the trusted texts of a fold; those
    of other texts, whose fold is -1, count 0."""
    keys, counts, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def merged():
        k = np.concatenate([keys, *(w[0] for w in waiting)])
        c = np.concatenate([counts, *(w[1] for w in waiting)])
        u, at = np.unique(k, return_inverse=True)
        return u, np.bincount(at, weights=c, minlength=len(u)).astype(np.int64)

    for pdf in rows:
        texts = [t.encode("utf-8", "replace") for t in pdf["text"]]
        fold = pdf["fold"].to_numpy(np.int64) + 1
        for a, b in chunks(texts):
            g, sizes = grams(texts[a:b])
            waiting.append(np.unique(g | np.repeat(fold[a:b], sizes) << 8 * ORDER, return_counts=True))
            if sum(len(w[0]) for w in waiting) > 500_000:
                keys, counts = merged()
                waiting = []
    keys, counts = merged()
    fold = keys >> 8 * ORDER
    counts[fold == 0] = 0
    for i in range(0, len(keys), 200_000):
        part = slice(i, i + 200_000)
        yield pd.DataFrame({"fold": (fold[part] - 1).astype(np.int32), "g": keys[part] & ((1 << 8 * ORDER) - 1), "c": counts[part]})


def _trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (id, ...) with `fold`: by hash of the id one of FOLDS if labels has quality 1 and doesn't call it toxic, else -1."""
    ids = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("id")).distinct().withColumn("hit", F.lit(True))
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    fold = F.when(F.col("hit"), F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int")).otherwise(-1)
    return docs.join(ids, "id", "left").withColumn("fold", fold).drop("hit")


def discounts(n: dict[int, int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the counts of counts n1..n4 (Chen and Goodman 1998), held within 0..1, 0..2, 0..3."""
    n1, n2, n3, n4 = (max(n.get(i, 0), 0) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return (
        min(max(1 - 2 * y * n2 / n1, 0.05), 1.0),
        min(max(2 - 3 * y * n3 / n2, 0.05), 2.0),
        min(max(3 - 4 * y * n4 / n3, 0.05), 3.0) if n3 else 0.9,
    )


def kneser_ney(table: DataFrame, order: int = ORDER) -> DataFrame:
    """table (m, g, c, asked): models, n-grams and their counts -> (m, g, p): probability of the last byte, for those asked for.

    p_k(g) = max(c(g) - D(c(g)), 0) / c(context .) + gamma(context) p_(k-1)(suffix), and p_(k-1)(suffix) alone where the
    context is new. Below the highest order c is the number of distinct bytes seen before the suffix. Order 0 is 1/256.
    """
    key = ["m", "g"]
    asked, counts = [table.where("asked").select(*key)], [table.where("c > 0").select(*key, "c")]
    for k in range(order - 1, 0, -1):
        mask = F.lit((1 << 8 * k) - 1)
        cut = F.col("g").bitwiseAND(mask).alias("g")
        asked.append(saved(asked[-1].select("m", cut).distinct(), "asked"))
        counts.append(saved(counts[-1].select("m", cut).groupBy(*key).agg(F.count("*").alias("c")), "counts"))
    p: DataFrame | None = None
    for k in range(1, order + 1):
        own = counts[order - k]
        of: dict[int, dict[int, int]] = {}
        for r in own.where("c <= 4").groupBy("m", "c").agg(F.count("*").alias("n")).collect():  # four a model
            of.setdefault(r["m"], {})[r["c"]] = r["n"]
        d1, d2, d3 = (F.coalesce(*[F.when(F.col("m") == m, discounts(n)[i]) for m, n in sorted(of.items())], F.lit(discounts({})[i])) for i in range(3))
        d = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        context = own.groupBy("m", F.shiftright("g", 8).alias("ctx")).agg(F.sum("c").alias("total"), F.sum(d).alias("kept_back"))
        q = asked[order - k].join(own, key, "left").withColumn("ctx", F.shiftright("g", 8)).join(context, ["m", "ctx"], "left")
        if p is None:
            q = q.withColumn("lower", F.lit(1 / 256))
        else:
            q = q.withColumn("s", F.col("g").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(p.select("m", F.col("g").alias("s"), F.col("p").alias("lower")), ["m", "s"])
        seen = F.coalesce(F.greatest(F.col("c") - d, F.lit(0.0)), F.lit(0.0)) / F.col("total") + F.col("kept_back") / F.col("total") * F.col("lower")
        p = saved(q.select("m", "g", F.coalesce(seen, F.col("lower")).alias("p")), "probabilities")
    return p


def _nll(texts: list[str | None], models: np.ndarray, found: Lookup) -> np.ndarray:
    """Mean negative log2 probability of a byte under each text's model; NaN for null and empty texts."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    out = np.full(len(raw), np.nan)
    for a, b in chunks(raw):
        g, sizes = grams(raw[a:b])
        total = np.concatenate([[0.0], np.cumsum(-np.log2(found.get(g | np.repeat(models[a:b], sizes) << 8 * ORDER)))])
        end = np.cumsum(sizes)
        with np.errstate(invalid="ignore", divide="ignore"):
            out[a:b] = (total[end] - total[end - sizes]) / sizes
    return out


def _by_broadcast(spark: SparkSession, rows: DataFrame, p: DataFrame) -> DataFrame:
    at = p.toArrow()
    shared = spark.sparkContext.broadcast(pickle.dumps((at["k"].to_numpy(), at["p"].to_numpy())))

    @F.pandas_udf("double")
    def nll(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        found = Lookup(*pickle.loads(shared.value), default=1 / 256)
        for text, model in batches:
            x = pd.Series(_nll(text.tolist(), model.to_numpy(np.int64), found))
            yield x.where(x.notna(), None)

    return rows.withColumn("nll", nll("text", "model"))


def _by_block(rows: DataFrame, p: DataFrame) -> DataFrame:
    """Without any broadcast: texts go to blocks by hash, and to each block the probabilities of the n-grams that it asks for."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, rows.sparkSession.sparkContext.defaultParallelism, size // BLOCK_BYTES)
    texts = rows.where("text IS NOT NULL AND text != ''").select(F.xxhash64("text").alias("t"), F.length("text").alias("len"), "model", "text").dropDuplicates(["t", "len", "model"])
    texts = texts.withColumn("block", F.pmod("t", F.lit(blocks)))

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for block, own in pdf.groupby("block"):
                raw, models = [t.encode("utf-8", "replace") for t in own["text"]], own["model"].to_numpy(np.int64)
                sets = []
                for a, b in chunks(raw):
                    g, sizes = grams(raw[a:b])
                    sets.append(np.unique(g | np.repeat(models[a:b], sizes) << 8 * ORDER))
                yield pd.DataFrame({"block": block, "k": np.unique(np.concatenate(sets))})

    def score(texts: pd.DataFrame, probabilities: pd.DataFrame) -> pd.DataFrame:
        found = Lookup(probabilities["k"].to_numpy(), probabilities["p"].to_numpy(), default=1 / 256)
        return pd.DataFrame({"t": texts["t"], "len": texts["len"], "model": texts["model"], "nll": _nll(texts["text"].tolist(), texts["model"].to_numpy(np.int64), found)})

    asked = texts.select("block", "model", "text").mapInPandas(ask, "block bigint, k bigint").distinct().join(p, "k")
    scores = texts.groupBy("block").cogroup(asked.groupBy("block")).applyInPandas(score, "t bigint, len int, model int, nll double")
    rows = rows.withColumns({"t": F.xxhash64("text"), "len": F.length("text")})
    return rows.join(scores, ["t", "len", "model"], "left").drop("t", "len")


def _model(docs: DataFrame, labels: DataFrame, quantile: float, broadcast_grams: int) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(lang_, cut): thresholds of nll by language; and what adds nll, under the model of all trusted documents, to rows with a text.

    Model k < FOLDS is of all trusted documents but those of fold k, model FOLDS of all; they are fitted together."""
    spark = docs.sparkSession
    small_batches(spark)
    narrow = docs.where("text IS NOT NULL AND text != ''").select(F.col("doc_id").cast("bigint").alias("id"), F.col("lang").alias("lang_"), "text")
    marked = _trusted(narrow, labels)
    counted = marked.select("text", "fold").mapInPandas(_count, "fold int, g bigint, c bigint")
    own = F.array(*[F.sum(F.when(F.col("fold") == k, F.col("c")).otherwise(0)) for k in range(FOLDS)], F.lit(0).cast("bigint"))
    grams_ = saved(counted.groupBy("g").agg(F.sum("c").alias("total"), own.alias("own")), "grams")
    each = grams_.select("g", "total", F.posexplode("own").alias("m", "own"))
    table = saved(each.select("m", "g", (F.col("total") - F.col("own")).alias("c"), ((F.col("m") == FOLDS) | (F.col("own") > 0)).alias("asked")).where("asked OR c > 0"), "models")
    p = kneser_ney(table).select("m", F.col("g").bitwiseOR(F.shiftleft(F.col("m").cast("bigint"), 8 * ORDER)).alias("k"), "p")

    def scored(rows: DataFrame, p: DataFrame) -> DataFrame:
        return _by_broadcast(spark, rows, p) if p.count() <= broadcast_grams else _by_block(rows, p)

    unseen = scored(marked.where("fold >= 0").select("lang_", "text", F.col("fold").alias("model")), p.where(F.col("m") < FOLDS).select("k", "p"))
    by_lang = saved(unseen.groupBy("lang_").agg(F.percentile_approx("nll", F.lit(quantile), F.lit(RANKS)).alias("cut")), "thresholds")
    return by_lang, lambda rows: scored(rows.withColumn("model", F.lit(FOLDS)), p.where(F.col("m") == FOLDS).select("k", "p")).drop("model")


def _with_cut(rows: DataFrame, by_lang: DataFrame) -> DataFrame:
    """rows (lang_, ...) with `cut`, the threshold of their language, null where it has no trusted text."""
    own = by_lang.withColumnRenamed("lang_", "l_")
    if own.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS:
        own = F.broadcast(own)
    return rows.join(own, F.col("lang_").eqNullSafe(F.col("l_")), "left")


def _rejects() -> Column:
    """null and empty texts are rejected; in languages without trusted text nothing else is."""
    return F.col("nll").isNull() | F.coalesce(F.col("nll") > F.col("cut"), F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, threshold, keep) for every row of docs.

    perplexity is 2 to the mean negative log2 probability of a byte under the model of the trusted documents (labels has
    quality 1 and not toxic 1). A document is rejected if it exceeds the threshold of its language: the quantile of the
    language's trusted documents, each scored by a model of the trusted documents outside its own fold. So it is at every
    size; a language with n trusted documents, n small, loses about one good document in n + 1. A language without trusted
    text has no threshold, and its documents aren't judged: every text that isn't empty is kept.

    Nulls: a null or empty text has no perplexity and is rejected. A null lang is a language of its own. A null doc_id is
    never trusted. A perplexity equal to the threshold is kept. Repeated rows are counted and judged each for itself; repeated labels count
    once. An empty table gives an empty result; without trusted text there are no thresholds and every text that isn't
    empty is kept. Texts of any length are read whole. Other columns aren't read.
    """
    by_lang, scored = _model(docs, labels, quantile, broadcast_grams)
    scores = scored(docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("lang").alias("lang_"), "text")).select("id", "lang_", F.octet_length("text").alias("bytes"), "nll")
    rows = _with_cut(scores, by_lang)
    power = lambda c: F.pow(F.lit(2.0), c)
    return rows.select(
        F.col("id").alias("doc_id"), F.col("lang_").alias("lang"), F.col("bytes").alias("n_bytes"), power(F.col("nll")).alias("perplexity"), power(F.col("cut")).alias("threshold"), (~_rejects()).alias("keep")
    )


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """The rows of docs that classify keeps, all columns; columns of any name pass through.

    Null and empty texts go; ties with the threshold stay; repeated rows are judged each for itself; an empty table gives an
    empty one, and without trusted text every text that isn't empty stays."""
    by_lang, scored = _model(docs, labels, quantile, broadcast_grams)
    rows = _with_cut(scored(packed(docs, text=F.col("text"), lang_=F.col("lang"))), by_lang)
    return rows.where(~_rejects()).select("row_.*")
