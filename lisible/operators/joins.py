"""Join helpers for keys that may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_SALT_BUCKETS = 32
#: A key is hot when it holds more than one row in HOT_SHARE (so at most HOT_SHARE keys can be) ...
HOT_SHARE = 1000
#: ... and more rows than one task takes anyway.
HOT_ROWS = 10_000


def hot_keys(big: DataFrame, on: list[str], rows: int = HOT_ROWS) -> DataFrame:
    """Keys of ``big`` that hold a large share of its rows: at most HOT_SHARE of them, whatever the input."""
    counts = big.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.where((F.col("_n") * HOT_SHARE > total) & (F.col("_n") > rows)).select(*on, F.lit(True).alias("_hot"))


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
                salt_from: list[str] | None = None, buckets: int = DEFAULT_SALT_BUCKETS,
                rows: int = HOT_ROWS) -> DataFrame:
    """Equi-join where one key of ``big`` may hold a large share of its rows.

    Only keys that are measured to be hot (``hot_keys``: partial+final counts
    over the key columns alone) are salted: their rows in ``big`` get a
    deterministic salt in ``[0, buckets)`` from a hash of ``salt_from``
    (row-identifying columns, so a retried task salts the same way), and
    their rows in ``small`` are replicated once per salt. All other keys join
    plainly. Each row meets exactly the partners it would meet without
    salt, so inner, left, left-semi and left-anti results are unchanged.
    """
    salt_cols = salt_from or [c for c in big.columns if c not in on]
    hot = F.broadcast(hot_keys(big, on, rows))   # at most HOT_SHARE rows
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in salt_cols]), F.lit(buckets))
    b = big.join(hot, on, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(F.lit(0).cast("bigint"))).drop("_hot")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(buckets - 1).cast("bigint")))
    cold_side = small.join(hot, on, "left_anti").withColumn("_salt", F.lit(0).cast("bigint"))
    hot_side = small.join(hot, on, "left_semi").withColumn("_salt", every)
    return b.join(cold_side.unionByName(hot_side), on + ["_salt"], how).drop("_salt")
