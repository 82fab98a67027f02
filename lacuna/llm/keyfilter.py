"""A bitmap of hashed keys: passes every key it was built from, and few others while it is sparse."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2^29 bits are 64 MB, the most that is ever sent to an executor.
LEAST_BITS, MOST_BITS = 16, 29


def bitmap(keys: DataFrame, column: str, n: int, slots: int = 16) -> np.ndarray:
    """Bits for the ``n`` long keys of ``keys`` as unsigned 64-bit words.

    There are about ``slots`` slots per key, 2^29 at most. With more keys the bitmap fills up and passes more; what passes
    is always joined with the keys themselves, so results do not depend on it. The driver gets one row for each
    word in use.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(n, 1) * slots)))))
    slots = keys.select(F.shiftrightunsigned(F.col(column), 64 - bits).alias("slot"))
    rows = slots.select(F.shiftright("slot", 6).alias("word"),
                        F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
    table = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[table["word"].to_numpy().astype(np.int64)] = table["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def passes(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the unsigned keys may be in the bitmap."""
    bits = int(np.log2(len(words))) + 6
    slot = keys >> np.uint64(64 - bits)
    return (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
