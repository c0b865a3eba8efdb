"""A filter of fixed size over 64-bit hashes: it may let strangers through and never stops a member."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of a filter as a power of two of bits; the broadcast is this many bits however large the tables are.
FILTER_BITS = 26


def members(hashes: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """Bits set by ``column`` (long), as bytes. What reaches the driver is at most ``2**bits / 64`` rows of 8 bytes."""
    place = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    word = F.shiftright(place, 6).alias("word")
    rows = hashes.select(word, F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("set"))
    out = np.zeros(1 << (bits - 6), np.int64)
    for batch in rows.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out.view(np.uint8)


def may_hold(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes.view(np.uint64) & np.uint64(len(filter_) * 8 - 1)
    return (filter_[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
