"""Bitmap of fixed size that tells which hashes can be in a set, however large the set is."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 2^24 bits are 2 MB; a larger set only lets more rows through to the exact join behind it.
BITS = 24


def slot_of(*columns) -> Column:
    """Slot of the values of some columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - BITS)


def bitmap(slots: DataFrame) -> np.ndarray:
    """Bitmap over a one-column table of slots; the words are put together in Spark, at most 2^18 rows come back."""
    slot = F.col(slots.columns[0])
    words = slots.groupBy(F.shiftright(slot, 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast({} & 63 as int))".format(slots.columns[0]))).alias("bits")).toArrow()
    found = np.zeros(1 << (BITS - 6), np.uint64)
    found[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return found


def passes(found: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which slots are set."""
    slots = slots.astype(np.int64)
    return (found[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1) != 0
