"""Hashes of a text's words, in numpy, without making the words."""

from __future__ import annotations

import numpy as np

from lexigrid.llm.common import Powers, chunks

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers = Powers()


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the 64-bit hashes of its words in order: lower case, runs of ASCII letters and digits and all bytes
    beyond ASCII."""
    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    out: list[np.ndarray] = []
    for a, b in chunks(raw):
        x = np.frombuffer(b"\n".join(raw[a:b]) + b"\n", np.uint8)
        edge = np.diff(_IS_WORD[x].astype(np.int8), prepend=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        h = _powers.spans(x, start, end)
        sizes = np.fromiter(map(len, raw[a:b]), np.int64, b - a) + 1
        out += np.split(h, np.searchsorted(start, np.cumsum(sizes)[:-1]))
    return out
