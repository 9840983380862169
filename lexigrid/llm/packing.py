"""Packing documents into training sequences: vector best-fit over tokens, documents and attention cost."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import MAX_PARTITIONS, saved, word_count

CAPACITY_TOKENS = 4096
CAPACITY_DOCS = 32
#: Sum of squared lengths, of the 4096**2 that one document of the whole length would cost.
CAPACITY_ATTENTION = int(0.4 * CAPACITY_TOKENS**2)
#: Longer documents are cut into pieces of at most so many tokens: the longest that an empty bin takes at that cost.
MAX_PIECE = math.isqrt(CAPACITY_ATTENTION)
WEIGHTS = (1.0, 0.1, 0.3)
#: Pieces packed together, as a mean; best fit is over all bins of a group, which one task holds.
GROUP_PIECES = 16_384
#: A null doc_id travels as known = false, as pandas has no null among integers.
SCHEMA = "bin_id bigint, slot int, doc_id bigint, known boolean, piece int, start_token bigint, n_tokens int"


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, ...] = WEIGHTS, method: str = "norm") -> np.ndarray:
    """The bin of each length, in the order given.

    Each goes to the bin, among those where it exceeds none of the three capacities, with the least weighted norm of what
    would be left ("norm"), or with the greatest weighted dot product of item and remainder, both as shares of capacity
    ("dot"); of equals the oldest. If none has room a bin is opened."""
    cap = np.asarray(capacity, dtype=float)
    w = np.asarray(weights, dtype=float)
    left = np.empty((len(lengths), 3))
    names = np.empty(len(lengths), dtype=np.int64)
    n_open = n_bins = 0
    out = np.empty(len(lengths), dtype=np.int64)
    least = float(lengths.min()) if len(lengths) else 0.0
    for i, length in enumerate(lengths.tolist()):
        item = np.array([length, 1.0, float(length) * length])
        r = left[:n_open]
        fits = np.flatnonzero((r[:, 0] >= item[0]) & (r[:, 1] >= 1.0) & (r[:, 2] >= item[2]))
        if len(fits):
            if method == "norm":
                score = (((r[fits] - item) / cap) ** 2) @ w
            else:
                score = -((r[fits] / cap) @ (w * item / cap))
            b = int(fits[np.argmin(score)])
        else:
            b = n_open
            left[b] = cap
            names[b] = n_bins
            n_open += 1
            n_bins += 1
        left[b] -= item
        out[i] = names[b]
        if left[b, 0] < least or left[b, 1] < 1 or left[b, 2] < least * least:  # nothing fits any more; the order of age stays
            left[b : n_open - 1] = left[b + 1 : n_open]
            names[b : n_open - 1] = names[b + 1 : n_open]
            n_open -= 1
    return out


def pack(
    docs: DataFrame,
    capacity_tokens: int = CAPACITY_TOKENS,
    capacity_docs: int = CAPACITY_DOCS,
    capacity_attention: int = CAPACITY_ATTENTION,
    max_piece: int = MAX_PIECE,
    weights: tuple[float, float, float] = WEIGHTS,
    method: str = "norm",
    tokens: Column | None = None,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """(bin_id, slot, doc_id, piece, start_token, n_tokens): every token of docs in exactly one bin, no capacity exceeded.

    tokens counts a text's tokens; op4 and the pipeline give the ids of op3's tokenizer, so start_token and n_tokens are a
    range of those ids. Without it a token is a run of non-blank characters, however long. Documents over max_piece tokens
    are cut into pieces. Pieces are drawn by hash into groups of about group_pieces; up to that many pieces there is one.
    In a group they are placed longest first by best_fit over all its bins; slot counts a bin's pieces in that order. Only
    ids and lengths are shuffled.

    Nulls: a null text has no tokens, a null doc_id is packed like any other. Texts without tokens are in no bin. Equal
    lengths go by doc_id, then piece. Repeated rows are packed each for itself, spread over the groups. Very long texts
    become many pieces. An empty table gives an empty result. Other columns aren't read.
    """
    if max_piece > capacity_tokens or max_piece**2 > capacity_attention or min(capacity_docs, max_piece, group_pieces) < 1:
        raise ValueError("a piece of max_piece tokens must fit an empty bin, and groups hold pieces")
    n = word_count(F.col("text")) if tokens is None else tokens.cast("bigint")
    sizes = saved(docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), n.alias("n")).where("n > 0"), "sizes")
    # Rows alike are numbered by counting them, so that the hash below parts them too.
    alike = sizes.groupBy("doc_id", "known", "n").agg(F.count("*").alias("rows")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    at = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / max_piece).cast("int") - 1)).alias("piece")
    start = F.col("piece").cast("bigint") * max_piece
    pieces = alike.select("doc_id", "known", "copy", "n", at).select("doc_id", "known", "copy", "piece", start.alias("start_token"), F.least(F.lit(max_piece), F.col("n") - start).cast("int").alias("n_tokens"))
    number = sizes.agg(F.sum(F.ceil(F.col("n") / max_piece))).first()[0] or 0
    groups = max(1, math.ceil(number / group_pieces))
    capacity = (capacity_tokens, capacity_docs, capacity_attention)

    def place(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "known", "doc_id", "piece"], ascending=[False, False, True, True], kind="stable", ignore_index=True)
        own = best_fit(rows["n_tokens"].to_numpy(), capacity, weights, method)
        rows["bin_id"] = (np.int64(keys[0]) << 32) + own
        rows["slot"] = rows.groupby("bin_id").cumcount().astype("int32")
        return rows[["bin_id", "slot", "doc_id", "known", "piece", "start_token", "n_tokens"]]

    placed = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "known", "copy", "piece", "n_tokens"), F.lit(groups))).repartition(min(groups, MAX_PARTITIONS), "g").groupBy("g").applyInPandas(place, SCHEMA)
    return placed.select("bin_id", "slot", F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "piece", "start_token", "n_tokens")
