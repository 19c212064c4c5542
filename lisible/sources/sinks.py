"""Catalog sinks: create, append, export.

Appends add files (one folder per ingest batch) instead of rewriting the
table; the JSON export writes JSON lines with probabilities kept to ten
decimals, the precision of the original records format.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lisible.constants import LEVELS
from lisible.sources.tables import ARTICLE_SCHEMA, SIMPLIFICATION_SCHEMA

EXPORT_DECIMALS = 10


def init_catalog(spark: SparkSession, path: str) -> None:
    """Create an empty article table if none exists (``ignore`` leaves an existing one alone)."""
    spark.createDataFrame([], ARTICLE_SCHEMA).write.mode("ignore").parquet(path)


def append_articles(rows: DataFrame, path: str, batch: int) -> None:
    """Append one batch as its own partition; re-running the batch overwrites only that partition."""
    (rows.select(*[f.name for f in ARTICLE_SCHEMA.fields]).withColumn("batch", F.lit(batch).cast("bigint"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path))


PREDICTION_COLUMNS = ["doc_id", "pos", "prediction", "status", "error"]
#: Folders that one simplification batch is dealt over, by article.
VERSION_BUCKETS = 64


def append_predictions(rows: DataFrame, path: str, run: int) -> None:
    """Store one run's predictions as its own partition; a run that is repeated overwrites only its own."""
    (rows.select(*PREDICTION_COLUMNS).withColumn("run", F.lit(run).cast("bigint"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path))


def scan_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Stored predictions that are done: one per (doc_id, pos), failed ones are to be tried again."""
    schema = "doc_id bigint, pos int, prediction string, status string, error string, run bigint"
    ok = spark.read.schema(schema).parquet(path).where(F.col("status") == "ok")
    return ok.groupBy("doc_id", "pos").agg(F.max_by("prediction", "run").alias("prediction"))


def append_simplifications(rows: DataFrame, path: str, batch: int) -> None:
    """Append one batch of versions, dealt into folders by article so that one article's versions lie together."""
    bucket = F.pmod(F.xxhash64("article_id"), F.lit(VERSION_BUCKETS))
    (rows.select(*[F.col(f.name).cast(f.dataType) for f in SIMPLIFICATION_SCHEMA.fields])
     .withColumns({"bucket": bucket, "batch": F.lit(batch).cast("bigint")})
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(path))


def export_json(articles: DataFrame, path: str) -> None:
    """JSON lines, fixed column order, levels rounded to ten decimals."""
    cols = [F.col(f.name) for f in ARTICLE_SCHEMA.fields if f.name not in LEVELS]
    cols += [F.round(F.col(lv), EXPORT_DECIMALS).alias(lv) for lv in LEVELS]
    articles.select(*cols).write.mode("overwrite").json(path)
