"""Sets of hashes as bitmaps of a fixed size.

A bitmap holds 2**bits bits whatever the set's size, so it may be broadcast. It has no false negatives. False positives
grow with the set; users only let rows through that an exact join settles afterwards, so results never depend on them.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 26


def bitmap_of(df: DataFrame, column: str, bits: int = BITS) -> Broadcast:
    """Broadcast bitmap (2**bits bits) of the hashes in a long column; at most 2**bits / 64 rows come to the driver."""
    places = df.select(F.shiftrightunsigned(F.col(column), 64 - bits).alias("place"))
    cells = places.groupBy(F.shiftright("place", 6).alias("cell")).agg(F.expr("bit_or(shiftleft(1L, CAST(place & 63 AS INT)))").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    return df.sparkSession.sparkContext.broadcast(out.view(np.uint64))


def among(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which unsigned hashes may be in the set."""
    place = h >> np.uint64(64 - (len(bitmap).bit_length() - 1 + 6))
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0
