"""Document fingerprints by winnowing (Schleimer, Wilkerson and Aiken 2003)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import Powers, chunks, small_batches

#: No match under NOISE letters and digits is found; every match of NOISE + WINDOW - 1 is.
NOISE = 24
WINDOW = 41
_powers = Powers()
_ALNUM = None


def _alnum() -> np.ndarray:
    """By code point, whether it is a letter or digit."""
    global _ALNUM
    if _ALNUM is None:
        _ALNUM = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
    return _ALNUM


def rightmost_minima(h: np.ndarray, window: int) -> np.ndarray:
    """For each window of h the index of its least value, of equals the rightmost; len(h) - window + 1 of them."""
    value, at, width = h, np.arange(len(h)), 1
    while width < window:
        step = min(width, window - width)
        a, b = value[:-step], value[step:]
        right = b <= a
        value, at, width = np.where(right, b, a), np.where(right, at[step:], at[:-step]), width + step
    return at


def fingerprints(texts: list[str | None], noise: int = NOISE, window: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, hashes) of each text: the offsets of the chosen k-grams' first characters, ascending."""
    raw = [(t or "").lower() if len((t or "").lower()) == len(t or "") else "".join(c if len(c.lower()) != 1 else c.lower() for c in t) for t in texts]
    coded = [t.encode("utf-32-le", "surrogatepass") for t in raw]
    empty = (np.zeros(0, np.int32), np.zeros(0, np.int64))
    out = [empty] * len(texts)
    for first, last in chunks(coded, 1 << 20):
        points = np.frombuffer(b"".join(coded[first:last]), np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded[first:last]])])
        place = np.flatnonzero(_alnum()[points])
        letters = points[place]
        bounds = np.searchsorted(place, starts)
        grams = len(letters) - noise + 1
        if grams <= 0:
            continue
        i = np.arange(grams)
        h = _powers.spans(letters, i, i + noise)
        for d in range(last - first):
            a, b = int(bounds[d]), int(bounds[d + 1]) - noise + 1
            if b <= a:
                continue
            chosen = a + np.unique(rightmost_minima(h[a:b], min(window, b - a)))
            out[first + d] = ((place[chosen] - starts[d]).astype(np.int32), h[chosen].view(np.int64))
    return out


def winnow(docs: DataFrame, noise: int = NOISE, window: int = WINDOW) -> DataFrame:
    """(doc_id, positions, hashes) for every row of docs.

    The text is taken in lower case, letters and digits alone. Every `noise` of them in a row are a k-gram with a 64-bit
    hash; of every `window` k-grams in a row the one with the least hash is kept, of equals the rightmost. So two texts that
    share noise + window - 1 letters and digits in a row share a fingerprint. positions are offsets into the text as it is.

    Nulls: a null text has empty arrays, a null doc_id stays null. A text with fewer than noise letters and digits has empty
    arrays; one with fewer than window k-grams has its least. Repeated rows are fingerprinted each for itself. An empty table
    gives an empty result. Texts of any length are read whole. Other columns aren't read.
    """
    small_batches(docs.sparkSession)
    if noise < 1 or window < 1:
        raise ValueError("noise and window must be at least 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = fingerprints(part.column("text").to_pylist(), noise, window)
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p, _ in found])]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[k] for f in found]))) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *lists], ["doc_id", "positions", "hashes"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, positions array<int>, hashes array<bigint>")
