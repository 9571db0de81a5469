"""Membership bitmaps that thin out rows before a shuffle.

A bitmap has about ``PER_KEY`` bits for each key that it was made of, and ``MOST`` at most, so it may be broadcast. It only ever
saves work: whatever passes is joined exactly afterwards. Where ``MOST`` bits are too few for the keys there is no bitmap,
everything passes, and the join alone does the work.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST, PER_KEY = 1 << 16, 1 << 27, 16


def build(keys: DataFrame, column: str, most: int = MOST) -> np.ndarray | None:
    """The words of the bitmap of a 64-bit integer column; at most ``most / 64`` rows reach the driver. None where a third of
    the bits would be set."""
    bit = F.expr(f"`{column}` & {most - 1}L")
    words = (
        keys.where(F.col(column).isNotNull())
        .select(F.shiftright(bit, 6).alias("w"), F.expr(f"shiftleft(1L, cast(`{column}` & 63L as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
    )
    table = words.toArrow()
    out = np.zeros(most // 64, dtype=np.uint64)
    out[table.column("w").to_numpy()] = table.column("b").to_numpy().view(np.uint64)
    held = int(np.bitwise_count(out).sum())
    if 3 * held > most:
        return None
    while 64 * len(out) > LEAST and 2 * PER_KEY * held <= 64 * len(out):
        out = out[: len(out) // 2] | out[len(out) // 2 :]
    return out


def passes(words: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    """Which of the unsigned 64-bit keys may be in the bitmap."""
    if words is None:
        return np.ones(len(keys), dtype=bool)
    bit = keys & np.uint64(64 * len(words) - 1)
    return (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
