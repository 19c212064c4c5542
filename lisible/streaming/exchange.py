"""Requests to a model service and its responses, matched as two streams.

Requests ``(doc_id, pos, attempt, sentence, asked_at)`` and responses
``(doc_id, pos, attempt, prediction, error, answered_at)`` arrive as files, in
any order and more than once. A response counts if it was given within ``wait``
of its request; a request whose time is over without one leaves the join as
``expired`` and is asked again, up to ``attempts`` times. Watermarks bound the
state: it holds the open requests and the responses of the last ``wait``, kept
in the RocksDB state store, and what a batch writes there is what it changed.

Every batch writes its own partition of the results, and a request that is
asked again twice after a replay is one request, so restarts change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lisible.session import PACKED, delete, discard, materialize, passing_shuffles

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: One store per partition holds both sides of the join (four otherwise, each with files of its own), and a batch
#: writes its changes to the checkpoint (packed), not the files of the whole store.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.join.stateFormatVersion": "3",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.compression.codec": "zstd",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",        # megabytes set aside for each store's files
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}
#: A batch's texts meet in slices of so many rows, and in so many slices at most.
SLICE_ROWS, SLICES = 500_000, 8
KEYS = ["doc_id", "pos", "attempt"]

ASKED_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("attempt", T.IntegerType()),
    T.StructField("sentence", T.StringType()), T.StructField("asked_at", T.TimestampType())])
ANSWER_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("attempt", T.IntegerType()),
    T.StructField("prediction", T.StringType()), T.StructField("error", T.StringType()), T.StructField("answered_at", T.TimestampType())])
RESULT_SCHEMA = T.StructType(ASKED_SCHEMA.fields + [
    T.StructField("prediction", T.StringType()), T.StructField("status", T.StringType()), T.StructField("error", T.StringType()),
    T.StructField("batch", T.LongType())])


def match(requests: DataFrame, responses: DataFrame, wait: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``(keys, asked_at, answered_at)``: each request once, with the time of its response, null if it expired."""
    asked = requests.select(*KEYS, "asked_at").withWatermark("asked_at", late).dropDuplicatesWithinWatermark(KEYS)
    answers = responses.select(*KEYS, "answered_at").withWatermark("answered_at", late).dropDuplicatesWithinWatermark(KEYS)
    answers = answers.select(*[F.col(k).alias(f"_{k}") for k in KEYS], "answered_at")
    on = [F.col(k) == F.col(f"_{k}") for k in KEYS]
    within = (F.col("answered_at") >= F.col("asked_at")) & (F.col("answered_at") <= F.col("asked_at") + F.expr(f"interval {wait}"))
    return asked.join(answers, on[0] & on[1] & on[2] & within, "left").select(*KEYS, "asked_at", "answered_at")


def with_texts(matched: DataFrame, requests: DataFrame, responses: DataFrame) -> DataFrame:
    """``(requests, prediction, status, error)`` of matched keys: ok, error or expired. Rows are found by key and time;
    of several at one time, the least counts."""
    asked = requests.select(*[F.col(k).alias(f"_{k}") for k in KEYS], F.col("asked_at").alias("_asked_at"), "sentence")
    found = matched.join(asked, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*KEYS, "asked_at"]]).drop(*[f"_{k}" for k in [*KEYS, "asked_at"]])
    answers = responses.withColumnRenamed("prediction", "_prediction")
    j = found.join(answers, [*KEYS, "answered_at"], "left")
    one = j.groupBy(*KEYS, "asked_at", "answered_at").agg(F.min(F.struct("sentence", "_prediction", "error")).alias("_t"))
    one = one.select(*KEYS, "asked_at", "answered_at", "_t.*")
    status = F.when(F.col("answered_at").isNull(), "expired").when(F.col("error").isNotNull() | F.col("_prediction").isNull(), "error").otherwise("ok")
    return one.select(*[f.name for f in ASKED_SCHEMA.fields], F.coalesce(F.when(F.col("error").isNull(), F.trim("_prediction")), F.col("sentence")).alias("prediction"),
                      status.alias("status"), "error")


def _between(column: str, low: int | None, high: int | None) -> Column:
    """Times (in microseconds) that a batch asks for, and missing ones; scans skip files of other times."""
    at = F.col(column)
    if low is None:
        return at.isNull()
    return at.isNull() | ((at >= F.timestamp_micros(F.lit(low))) & (at <= F.timestamp_micros(F.lit(high))))


def start_exchange(spark: SparkSession, requests: str, responses: str, sink: str, checkpoint: str, wait: str = "1 hour", late: str = "10 minutes",
                   attempts: int = 3, clock: Column | None = None, files_per_trigger: int = 64, available_now: bool = True):
    """Start matching the folders ``requests`` and ``responses`` into ``sink``; returns the StreamingQuery.

    Expired requests with attempts left are written to ``requests`` again, asked
    at ``clock`` (the present time unless given).
    """
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    read = lambda schema, path: spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    now = F.current_timestamp() if clock is None else clock

    def write(batch: DataFrame, epoch: int) -> None:
        session, own = batch.sparkSession, f"{sink}/batch={epoch}"
        matched = materialize(batch, "exchange-matched", **PACKED)
        delete(session, own)   # of a try that did not end
        n, *spans = matched.agg(F.count(F.lit(1)), *[F.unix_micros(f(c)) for c in ("asked_at", "answered_at") for f in (F.min, F.max)]).first()
        asked = session.read.schema(ASKED_SCHEMA).parquet(requests).where(_between("asked_at", *spans[:2]))
        answers = session.read.schema(ANSWER_SCHEMA).parquet(responses).where(_between("answered_at", *spans[2:]))
        slices = min(SLICES, -(-n // SLICE_ROWS))
        for i in range(slices):
            mine = F.pmod(F.xxhash64(*KEYS), F.lit(slices)) == i
            texts = with_texts(*(df.where(mine) for df in (matched, asked, answers)))
            texts.withColumn("batch", F.lit(epoch).cast("bigint")).write.mode("append").partitionBy("batch").options(**PACKED).parquet(sink)
        discard(matched)
        if not n:
            return
        made = session.read.schema(RESULT_SCHEMA).parquet(sink).where((F.col("batch") == epoch) & (F.col("status") == "expired"))
        again = made.where(F.col("attempt") + 1 < attempts).select("doc_id", "pos", (F.col("attempt") + 1).alias("attempt"), "sentence", now.alias("asked_at"))
        if not again.isEmpty():
            again.write.mode("append").options(**PACKED).parquet(requests)

    writer = match(read(ASKED_SCHEMA, requests), read(ANSWER_SCHEMA, responses), wait, late).writeStream.outputMode("append") \
        .foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    with passing_shuffles(spark):   # the query runs in a copy of the session as it is at the start
        return writer.start()


def read_results(spark: SparkSession, sink: str) -> DataFrame:
    from lisible.sources.tables import scan_or_empty
    return scan_or_empty(spark, sink, RESULT_SCHEMA)


def final_predictions(results: DataFrame) -> DataFrame:
    """The last state of every sentence: an answer if any attempt got one, else ``expired`` with the sentence itself."""
    rank = F.struct((F.col("status") != "expired").cast("int").alias("answered"), F.col("attempt").alias("attempt"))
    return results.groupBy("doc_id", "pos").agg(*[F.max_by(c, rank).alias(c) for c in ("prediction", "status", "attempt")])
