"""Bloom filters of a fixed size: which rows may have a key, told where the rows stand.

A join that touches few of many rows exchanges only the rows that the filter
lets pass; the filter loses none of them, and the join decides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter, whatever the number of hashes in it (8 Mbit are 1 MB); a fuller one only lets more rows pass.
BLOOM_BITS = 1 << 23


def bloom_positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    low = (hashes & np.uint64(bits - 1)).astype(np.int64)
    high = ((hashes >> np.uint64(40)) & np.uint64(bits - 1)).astype(np.int64)
    return low, high


def bloom_filter(hashes: DataFrame, bits: int = BLOOM_BITS) -> np.ndarray:
    """Bytes of a Bloom filter over ``h``; its set positions are summed up to words of 64 bits before they leave the tasks."""
    h = F.col("h")
    low, high = h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(bits - 1))
    words = hashes.select(F.explode(F.array(low, high)).alias("at")) \
        .groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("value"))
    out = np.zeros(bits // 64, np.uint64)
    for r in words.collect():  # at most bits / 64 rows, whatever the number of items
        out[r["word"]] = np.uint64(r["value"] & 0xFFFFFFFFFFFFFFFF)
    return out


def may_hold(hashes: DataFrame):
    """A function from a column of hashes to a boolean column: false only for hashes that are not in ``h``. Only the hashes meet Python."""
    bloom = bloom_filter(hashes)
    bits = len(bloom) * 64
    shared = hashes.sparkSession.sparkContext.broadcast(bloom)

    @F.pandas_udf("boolean")
    def told(h: pd.Series) -> pd.Series:
        words = shared.value
        low, high = bloom_positions(h.to_numpy(dtype=np.int64).view(np.uint64), bits)
        holds = lambda at: (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
        return pd.Series(holds(low) & holds(high))

    return told


def not_among(rows: DataFrame, gone: DataFrame, on: Column) -> DataFrame:
    """``rows`` (row, h, ...) without a partner in ``gone`` (h, ...), their struct ``row`` unfolded.

    Rows that the filter tells apart stay where they stand, the others meet ``gone`` in a join.
    """
    hit = may_hold(gone.select("h"))
    far = rows.where(~hit(F.col("h"))).select("row.*")
    near = rows.where(hit(F.col("h"))).drop("h").join(gone.drop("h").hint("merge"), on, "left_anti").select("row.*")
    return far.unionByName(near)
