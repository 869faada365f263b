"""Membership bitmaps of fixed size: what they lack is certainly not in the set, so they only ever spare work."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 26


def place(hashed: Column | str) -> Column:
    """The place of a well-mixed 64-bit hash: its lowest bits."""
    return (F.col(hashed) if isinstance(hashed, str) else hashed).bitwiseAND((1 << BITS) - 1).cast("int")


def bitmap_of(df: DataFrame, place_column: str) -> np.ndarray:
    """The bitmap of all places in a column, as 2^BITS / 8 bytes (8 MB) whatever the table's size.

    Bits are put together before the shuffle; at most 2^BITS / 64 rows of two numbers reach the driver.
    """
    p = F.col(place_column)
    words = (
        df.select(F.shiftright(p, 6).alias("word"), F.expr(f"shiftleft(1L, {place_column} & 63)").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    )
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def holds(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bitmap[places >> 3] >> (places & 7).astype(np.uint8)) & 1 > 0


def places_of(hashes: np.ndarray) -> np.ndarray:
    """`place` for numpy's unsigned 64-bit hashes."""
    return (hashes & np.uint64((1 << BITS) - 1)).astype(np.int64)
