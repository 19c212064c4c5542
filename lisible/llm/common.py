"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lisible.session import materialize

#: A key counts as hot when it holds at least one row in HOT_SHARE. At most HOT_SHARE keys
#: can be hot, whatever the input's size, so the table of hot keys may be broadcast.
HOT_SHARE = 1000

#: Words are runs of anything but these (regular expression class, ASCII white space).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


#: Rows and bytes that one Arrow batch of texts holds at most (a longer text is a batch of its own). Workers and the
#: JVM hold a few batches each, so this bounds their memory whatever the texts' lengths.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to BATCH_ROWS and BATCH_BYTES; limits that are lower already stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        text = str(spark.conf.get(key, None))
        now = int(text.lower().rstrip("b")) if text.lower().rstrip("b").lstrip("-").isdigit() else 0
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_mod(doc_id, modulus: int):
    """Remainder of crc32 of the id written as text; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a derived table once under the shared checkpoint folder and read it back."""
    bound_batches(df.sparkSession)
    return materialize(df, name)


def join_on_hot_key(rows: DataFrame, per_key: DataFrame, key: list[str], weight: str, total: int) -> DataFrame:
    """Left join of many ``rows`` with one row per key, where a key may hold a third of all rows.

    ``weight`` is the column of ``per_key`` that says how many rows the key has.
    Keys with at least ``total / HOT_SHARE`` rows (at most ``HOT_SHARE`` keys, a
    bound that does not depend on the data) are joined by broadcast, where the
    rows stand; the other keys meet in a shuffle whose groups are small.
    Null keys match null keys.
    """
    bar = max(1, -(-total // HOT_SHARE))
    columns = [c for c in per_key.columns if c not in key]
    hot = per_key.where(F.col(weight) >= F.lit(bar)).withColumn("_hot", F.lit(True))
    cold = per_key.where(F.col(weight) < F.lit(bar))

    def matched(left, right):
        other = right.select(*[F.col(k).alias(f"_k_{k}") for k in key], *[c for c in right.columns if c not in key])
        on = [left[k].eqNullSafe(other[f"_k_{k}"]) for k in key]
        return left.join(other, on, "left").drop(*[f"_k_{k}" for k in key])

    near = matched(rows, F.broadcast(hot))
    done = near.where("_hot").drop("_hot")
    rest = near.where("_hot is null").drop("_hot", *columns)
    return done.unionByName(matched(rest, cold))
