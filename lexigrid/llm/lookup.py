"""A read-only map from 64-bit keys to values, in numpy: levels of hashed slots, each key on the first level where it is alone."""

from __future__ import annotations

import numpy as np

from lexigrid.llm.common import U64, mix

_STEP = 0x9E3779B97F4A7C15


def place(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The slot of each key among 2**bits on a level."""
    with np.errstate(over="ignore"):
        return (mix(keys.astype(U64) + U64((_STEP * (level + 1)) & (2**64 - 1))) >> U64(64 - bits)).astype(np.int64)


class Lookup:
    """keys: distinct. Missing keys get `default`. Two or three array reads a key, whatever the size."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, default: float = 0.0) -> None:
        self.default, self.dtype = default, values.dtype
        self.levels: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        keys, level = keys.astype(np.int64), 0
        while len(keys):
            bits = max(4, int(np.ceil(np.log2(len(keys) * 2))))
            at = place(keys, level, bits)
            alone = np.bincount(at, minlength=1 << bits)[at] == 1
            slot_keys, slot_values, full = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, values.dtype), np.zeros(1 << bits, bool)
            slot_keys[at[alone]], slot_values[at[alone]], full[at[alone]] = keys[alone], values[alone], True
            self.levels.append((bits, slot_keys, slot_values, full))
            keys, values, level = keys[~alone], values[~alone], level + 1

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), self.default, self.dtype)
        left = None
        for level, (bits, slot_keys, slot_values, full) in enumerate(self.levels):
            k = keys if left is None else keys[left]
            at = place(k, level, bits)
            hit = (slot_keys[at] == k) & full[at]
            if left is None:
                out[hit] = slot_values[at[hit]]
                left = np.flatnonzero(~hit)
            else:
                out[left[hit]] = slot_values[at[hit]]
                left = left[~hit]
            if not len(left):
                break
        return out
