"""Bit tables of fixed size: which hash values occur in a column."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bit_table(rows: DataFrame, hashes: Column, bits: int) -> np.ndarray:
    """Bytes of a table of 2 ** ``bits`` bits with the low bits of every hash set.

    Only the table reaches the driver. Values that are in the column always
    pass ``holds``; the fuller the table, the more others pass as well.
    """
    slot = F.pmod(hashes, F.lit(1 << bits)).cast("int")
    by_byte = rows.select(slot.alias("s")).groupBy(F.expr("s div 8").cast("int").alias("at"))
    found = by_byte.agg(F.expr("bit_or(cast(shiftleft(1, cast(s % 8 as int)) as int))").alias("v")).toArrow()
    table = np.zeros((1 << bits) // 8, np.uint8)
    if found.num_rows:
        table[found.column("at").to_numpy()] = found.column("v").to_numpy().astype(np.uint8)
    return table


def holds(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes (uint64) may be in the column."""
    slot = (hashes & np.uint64(8 * len(table) - 1)).astype(np.int64)
    return ((table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)
