"""Stored forms of the catalog whose upkeep is in proportion to what is added.

- URL index: the catalog's URLs as a table bucketed by URL, so the check of a
  batch moves the batch alone.
- Audit parts: counters, id bitmaps and URL counts per batch; an audit merges
  parts and reads no article.
- Card pages: cards clustered by id over files, with a small index of the
  files' first and last ids, so a page opens the files that hold it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lisible.constants import LEVELS, TEXT_URL


# ----------------------------------------------------------------------------
# URL index
# ----------------------------------------------------------------------------

def open_url_index(spark: SparkSession, name: str, path: str, buckets: int | None = None) -> None:
    """Register (or open again after a restart) the URL index ``name`` stored under ``path``.

    It has at least as many buckets as shuffles have partitions; else the
    planner would rather exchange both sides of a join with it.
    """
    buckets = buckets or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (url STRING) USING parquet CLUSTERED BY (url) SORTED BY (url) INTO {buckets} BUCKETS LOCATION '{path}'")


def add_urls(urls: DataFrame, name: str) -> None:
    """Append the distinct URLs of new articles; pasted texts have no place in the index."""
    urls.where(F.col("url") != F.lit(TEXT_URL)).select("url").distinct().write.insertInto(name)


def new_urls_indexed(batch: DataFrame, name: str, order_by: str = "page_id") -> DataFrame:
    """``new_urls`` against the index: the batch is exchanged by URL once, for the first row per URL and for the check.

    A URL that a large share of the batch repeats is reduced to one row in the
    tasks first (window group limit).
    """
    known = batch.sparkSession.table(name)
    crawled = batch.where(F.col("url") != F.lit(TEXT_URL))
    by_url = Window.partitionBy("url").orderBy(order_by)
    first = crawled.withColumn("_rn", F.row_number().over(by_url)).where("_rn = 1").drop("_rn")
    # rows at the planner's choice of partitions would be exchanged again for the buckets, so they are dealt there at once
    others = batch.where(F.col("url").isNull() | (F.col("url") == F.lit(TEXT_URL)))
    return first.join(known.hint("merge"), "url", "left_anti").select(*batch.columns).unionByName(others)


# ----------------------------------------------------------------------------
# audit parts
# ----------------------------------------------------------------------------

def write_audit_part(articles: DataFrame, path: str, batch: int) -> None:
    """Store the audit of one batch of articles under ``path``; writing a batch again replaces its part."""
    if "_corrupt_record" not in articles.columns:
        articles = articles.withColumn("_corrupt_record", F.lit(None).cast("string"))
    total = sum((F.col(lv) for lv in LEVELS[1:]), F.col(LEVELS[0]))
    one = lambda condition: F.coalesce(F.sum(condition.cast("bigint")), F.lit(0))
    counters = articles.agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("article_id").alias("min_id"), F.max("article_id").alias("max_id"),
        one(F.col("title").isNull()).alias("null_titles"), one(F.col("text").isNull()).alias("null_texts"),
        one(F.abs(total - F.lit(1.0)) > F.lit(1e-6)).alias("bad_probability_sums"), F.count("_corrupt_record").alias("corrupt_rows"))
    # one bit per id, 32,768 ids to a row; distinct ids are bits, whatever the batches they came with
    ids = articles.where("article_id is not null").groupBy(F.bitmap_bucket_number("article_id").alias("bucket")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("article_id")).alias("bits"))
    urls = articles.where(F.col("url") != F.lit(TEXT_URL)).groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    for kind, part in (("counters", counters), ("ids", ids), ("urls", urls)):
        part.write.mode("overwrite").parquet(os.path.join(path, kind, f"batch={batch}"))


def merged_audit(spark: SparkSession, path: str) -> DataFrame:
    """The audit of all batches from their parts: the columns of ``catalog_audit``, no article read, no distinct count."""
    counters = spark.read.parquet(os.path.join(path, "counters")).agg(
        F.sum("n_rows").alias("n_rows"), F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id"), F.sum("null_titles").alias("null_titles"),
        F.sum("null_texts").alias("null_texts"), F.sum("bad_probability_sums").alias("bad_probability_sums"), F.sum("corrupt_rows").alias("corrupt_rows"))
    ids = spark.read.parquet(os.path.join(path, "ids")).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    n_ids = ids.select(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0))).scalar()
    urls = spark.read.parquet(os.path.join(path, "urls")).groupBy("url").agg(F.sum("n").alias("n")).where("n > 1")
    dense = (F.col("n_ids") == F.col("n_rows")) & (F.coalesce(F.col("max_id") - F.col("min_id") + 1, F.lit(0)) == F.col("n_rows"))
    out = counters.withColumn("n_ids", F.lit(n_ids).cast("bigint")).withColumn("duplicate_urls", F.lit(urls.select(F.count(F.lit(1))).scalar()).cast("bigint"))
    numbers = ["n_rows", "n_ids", "min_id", "max_id", "null_titles", "null_texts", "bad_probability_sums", "duplicate_urls", "corrupt_rows"]
    return out.select(*[F.col(c).cast("bigint").alias(c) for c in numbers], dense.alias("ids_dense"))


# ----------------------------------------------------------------------------
# card pages
# ----------------------------------------------------------------------------

def write_cards(cards: DataFrame, path: str, files: int | None = None) -> None:
    """Store cards clustered by id: every file holds a range of ids in order; beside them the index of the files."""
    spark = cards.sparkSession
    ranged = cards.repartitionByRange(files, "article_id") if files else cards.repartitionByRange("article_id")
    ranged.sortWithinPartitions("article_id").write.parquet(os.path.join(path, "cards"))
    stored = spark.read.parquet(os.path.join(path, "cards"))
    stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.min("article_id").alias("first_id"), F.max("article_id").alias("last_id"), F.count(F.lit(1)).alias("n")) \
        .coalesce(1).write.parquet(os.path.join(path, "index"))  # one row per file


def page_files(spark: SparkSession, path: str, after: int, size: int) -> list[str]:
    """The files that hold the ``size`` cards after the id ``after``: the index is read, no card is."""
    index = spark.read.parquet(os.path.join(path, "index")).where(F.col("last_id") > after)
    before = F.coalesce(F.sum("n").over(Window.orderBy("first_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the first file may hold cards up to ``after`` too, so one more is taken than the counts alone ask for
    part = F.when(F.col("first_id") > after, F.lit(0)).otherwise(F.col("n"))
    ahead = F.max(part).over(Window.orderBy("first_id").rowsBetween(Window.unboundedPreceding, -1))
    chosen = index.withColumn("ahead", before - F.coalesce(ahead, F.lit(0))).where(F.col("ahead") < size).orderBy("first_id").select("file")
    return [os.path.join(path, "cards", r["file"]) for r in chosen.collect()]


def listing_page(spark: SparkSession, path: str, after: int = -1, size: int = 20) -> DataFrame:
    """Up to ``size`` cards with ids beyond ``after``, in order (keyset paging)."""
    files = page_files(spark, path, after, size)
    if not files:
        return spark.read.parquet(os.path.join(path, "cards")).limit(0)
    return spark.read.parquet(*files).where(F.col("article_id") > after).orderBy("article_id").limit(size)
