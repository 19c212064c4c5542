"""Queued simplification requests processed as a stream.

Requests ``(article_id, n, model, seq)`` arrive as files; ``seq`` is their order. Each micro-batch
resolves the model, works out which ordinals are missing given what is
already stored (version counts per article: one snapshot of totals per batch,
of which a batch reads the last one), creates them from the original article text, re-scores them and writes them as the
batch's own partition — idempotent under replay like the ingest stream. Requests that cannot be served go to
``{sink}_rejected`` with one reason, so served and refused requests are all requests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lisible.constants import LEVELS
from lisible.operators import simplify as sp
from lisible.session import materialize

REQUEST_SCHEMA = T.StructType([
    T.StructField("article_id", T.LongType()),
    T.StructField("n", T.LongType()),
    T.StructField("model", T.StringType()),
    T.StructField("seq", T.LongType()),   # order of arrival
])

VERSION_SCHEMA = T.StructType([
    T.StructField("article_id", T.LongType()),
    T.StructField("simplification_id", T.LongType()),
    T.StructField("model", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
] + [T.StructField(lv, T.DoubleType()) for lv in LEVELS] + [T.StructField("batch", T.LongType())])


REFUSED_SCHEMA = T.StructType(REQUEST_SCHEMA.fields + [T.StructField("reason", T.StringType()), T.StructField("batch", T.LongType())])
COUNT_SCHEMA = T.StructType([T.StructField("article_id", T.LongType()), T.StructField("_count", T.LongType()), T.StructField("batch", T.LongType())])


def simplify_batch(batch: DataFrame, epoch_id: int, sink: str, articles: DataFrame, initial: DataFrame,
                   registry: DataFrame) -> None:
    from lisible.streaming.ingest import _write_partition, latest_snapshot
    spark = batch.sparkSession
    state = f"{sink}_state"
    # versions per article so far: the last snapshot of totals (before the first batch: the initial table)
    before = latest_snapshot(spark, state, COUNT_SCHEMA, epoch_id).drop("batch")
    if before.isEmpty():
        before = initial.groupBy("article_id").agg(F.count(F.lit(1)).alias("_count"))
    default = sp.default_model(registry)
    status = materialize(sp.request_status(batch, registry, articles, default), "simplify-requests")
    refused = status.where("reason is not null").select("article_id", "n", "model", "seq", "reason")
    _write_partition(refused, f"{sink}_rejected", epoch_id)
    todo = sp.pending_simplifications(status.where("reason is null"), before, default, counted=True)
    rows = sp.simplify_and_rescore(todo, articles)
    _write_partition(rows.select(*[f.name for f in VERSION_SCHEMA.fields if f.name != "batch"]), sink, epoch_id)
    made = spark.read.schema(VERSION_SCHEMA).parquet(sink).where(F.col("batch") == epoch_id)
    new = made.groupBy("article_id").agg(F.count(F.lit(1)).alias("_count"))
    _write_partition(before.unionByName(new).groupBy("article_id").agg(F.sum("_count").alias("_count")), state, epoch_id)


def read_refused(spark: SparkSession, sink: str) -> DataFrame:
    from lisible.sources.tables import scan_or_empty
    return scan_or_empty(spark, f"{sink}_rejected", REFUSED_SCHEMA)


def start_simplify(spark: SparkSession, source: str, sink: str, checkpoint: str, articles: DataFrame,
                   initial: DataFrame, registry: DataFrame, available_now: bool = True, files_per_trigger: int = 64):
    stream = spark.readStream.schema(REQUEST_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    writer = (stream.writeStream
              .foreachBatch(lambda df, epoch: simplify_batch(df, epoch, sink, articles, initial, registry))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
