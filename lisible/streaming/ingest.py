"""Incremental article ingestion from a stream of crawled pages.

Each micro-batch: keep the first submission per URL and drop URLs already
in the catalog, update the per-host block statistics (state: additive
counts per batch), extract and score the pages with templates judged on
all pages seen so far, give dense ids after the committed maximum, and
write the batch as its own partition (``batch=<epoch>``, dynamic overwrite). A batch replayed after a failure
reads only earlier batches as committed state and overwrites its own
partition, so the result is the same as a single clean run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lisible.constants import LEVELS
from lisible.operators.catalog import assign_dense_ids, new_urls

PAGES_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

CATALOG_SCHEMA = T.StructType([
    T.StructField("article_id", T.LongType()),
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("image", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("text", T.StringType()),
] + [T.StructField(lv, T.DoubleType()) for lv in LEVELS] + [T.StructField("batch", T.LongType())])


def _committed(spark: SparkSession, sink: str, before_batch: int) -> DataFrame:
    from lisible.sources.tables import scan_or_empty
    return scan_or_empty(spark, sink, CATALOG_SCHEMA).where(F.col("batch") < before_batch)


BLOCK_STATS_SCHEMA = T.StructType([T.StructField("host", T.StringType()), T.StructField("key", T.LongType()),
                                   T.StructField("n_pages", T.LongType()), T.StructField("batch", T.LongType())])
HOST_STATS_SCHEMA = T.StructType([T.StructField("host", T.StringType()), T.StructField("host_pages", T.LongType()),
                                  T.StructField("batch", T.LongType())])


def _write_partition(df: DataFrame, path: str, epoch_id: int) -> None:
    (df.withColumn("batch", F.lit(epoch_id).cast("bigint"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path))


def latest_snapshot(spark: SparkSession, path: str, schema: T.StructType, epoch_id: int) -> DataFrame:
    """The newest totals before this epoch: one snapshot, however many batches there were."""
    from lisible.sources.tables import scan_or_empty
    all_ = scan_or_empty(spark, path, schema)
    newest = all_.where(F.col("batch") < epoch_id).agg(F.max("batch")).first()[0]   # partition values only
    return all_.where(F.col("batch") == F.lit(-1 if newest is None else newest))


def _cumulative_statistics(spark: SparkSession, blocks: DataFrame, state: str, epoch_id: int):
    """Block statistics of all batches so far: the last snapshot of totals plus this batch, written as the next one."""
    from lisible.operators.pages import block_statistics
    per_key, per_host = block_statistics(blocks)
    out = []
    for name, new, keys, value, schema in (("blocks", per_key, ["host", "key"], "n_pages", BLOCK_STATS_SCHEMA),
                                           ("hosts", per_host, ["host"], "host_pages", HOST_STATS_SCHEMA)):
        before = latest_snapshot(spark, f"{state}/{name}", schema, epoch_id).drop("batch")
        total = new.unionByName(before).groupBy(*keys).agg(F.sum(value).alias(value))
        _write_partition(total, f"{state}/{name}", epoch_id)
        out.append(spark.read.schema(schema).parquet(f"{state}/{name}").where(F.col("batch") == epoch_id).drop("batch"))
    return tuple(out)


REJECTED_SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                                T.StructField("reason", T.StringType()), T.StructField("batch", T.LongType())])


def ingest_batch(batch: DataFrame, epoch_id: int, sink: str, image_sizes: DataFrame | None = None) -> None:
    """One micro-batch: accepted pages go to ``sink``, the others with their reason to ``{sink}_rejected``.

    Template statistics are cumulative over all batches so far; the state
    next to the sink is one snapshot of totals per batch, of which a batch
    reads the last one only. Pages whose URL is known already are
    rejected as ``known_url``, so accepted and rejected pages are all pages.
    """
    from lisible.operators.pages import page_article_status
    from lisible.session import materialize
    spark = batch.sparkSession
    committed = _committed(spark, sink, epoch_id)
    pages = batch.select("page_id", "url", "html")
    fresh = new_urls(pages, committed.select("url"), order_by="page_id")
    stats = lambda blocks: _cumulative_statistics(spark, blocks, f"{sink}_state", epoch_id)
    status = materialize(page_article_status(fresh, image_sizes, statistics=stats), "ingest-status")
    known = pages.select("page_id", "url").join(status.select(F.col("page_id").alias("_p")), F.col("page_id").eqNullSafe(F.col("_p")), "left_anti") \
        .withColumn("reason", F.lit("known_url"))
    _write_partition(status.where("reason is not null").select("page_id", "url", "reason").unionByName(known), f"{sink}_rejected", epoch_id)
    next_id = committed.agg(F.coalesce(F.max("article_id") + 1, F.lit(0).cast("bigint")))
    with_ids = assign_dense_ids(status.where("reason is null").drop("reason"), "page_id", base=next_id)
    _write_partition(with_ids.select(*[f.name for f in CATALOG_SCHEMA.fields if f.name != "batch"]), sink, epoch_id)


def start_ingest(spark: SparkSession, source: str, sink: str, checkpoint: str,
                 files_per_trigger: int = 1, available_now: bool = True, glob: str | None = None,
                 image_sizes: DataFrame | None = None):
    """Start the stream ``source`` (folder of parquet pages) → catalog ``sink``; returns the StreamingQuery.

    ``image_sizes(src, width)`` holds crawled widths of images that declare none.
    """
    reader = spark.readStream.schema(PAGES_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    stream = reader.parquet(source)
    writer = (stream.writeStream.foreachBatch(lambda df, epoch: ingest_batch(df, epoch, sink, image_sizes))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def read_rejected(spark: SparkSession, sink: str) -> DataFrame:
    from lisible.sources.tables import scan_or_empty
    return scan_or_empty(spark, f"{sink}_rejected", REJECTED_SCHEMA)


def read_catalog(spark: SparkSession, sink: str) -> DataFrame:
    from lisible.sources.tables import scan_or_empty
    return scan_or_empty(spark, sink, CATALOG_SCHEMA)
