"""Bloom filters over 64-bit tokens: a first test of rows before they are shuffled; exact joins follow."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter for each token.
_PROBES = 4


def known(on: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the hashes that a filter lets through."""
    mask = np.uint64(8 * len(on) - 1)
    low, high, at = h & mask, (h >> np.uint64(32) | np.uint64(1)) & mask, np.arange(len(h))
    for j in range(_PROBES):
        slot = low[at] + np.uint64(j) * high[at] & mask
        at = at[on[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 > 0]
    return at


def build(tokens: DataFrame, bits: int) -> np.ndarray:
    """A filter of the column token: 16 bits for each, but not above 2 ** `bits`, four of them on."""
    size = min(bits, max(16, (16 * tokens.count()).bit_length()))
    low, high, mask = F.col("token"), F.shiftrightunsigned("token", 32).bitwiseOR(1), (1 << size) - 1
    slots = F.array(*((low.bitwiseAND(mask) + j * high.bitwiseAND(mask)).bitwiseAND(mask) for j in range(_PROBES)))
    slot = tokens.select(F.explode(slots).alias("slot")).distinct()
    parts = slot.groupBy(F.shiftright("slot", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(32767)).alias("on")).collect()
    on = np.zeros(1 << size - 3, np.uint8)
    for p in parts:
        on[p.part * 4096 : (p.part + 1) * 4096] = np.frombuffer(bytes(p.on), np.uint8)[: len(on)]
    return on
