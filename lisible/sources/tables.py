"""Scans of the input tables and of the stored catalogs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lisible.constants import LEVELS

TABLES = ["documents", "pages", "conversations", "labels"]

ARTICLE_SCHEMA = T.StructType(
    [
        T.StructField("article_id", T.LongType(), False),
        T.StructField("url", T.StringType(), True),
        T.StructField("title", T.StringType(), True),
        T.StructField("image", T.StringType(), True),
        T.StructField("description", T.StringType(), True),
        T.StructField("text", T.StringType(), True),
    ]
    + [T.StructField(lv, T.DoubleType(), True) for lv in LEVELS]
)

SIMPLIFICATION_SCHEMA = T.StructType(
    [
        T.StructField("article_id", T.LongType(), False),
        T.StructField("simplification_id", T.IntegerType(), False),
        T.StructField("model", T.StringType(), True),
        T.StructField("title", T.StringType(), True),
        T.StructField("text", T.StringType(), True),
    ]
    + [T.StructField(lv, T.DoubleType(), True) for lv in LEVELS]
)

REGISTRY_SCHEMA = T.StructType([
    T.StructField("model", T.StructType([
        T.StructField("object", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("finished_at", T.LongType()),
        T.StructField("fine_tuned_model", T.StringType()),
        T.StructField("organization_id", T.StringType()),
        T.StructField("result_files", T.ArrayType(T.StringType())),
        T.StructField("status", T.StringType()),
        T.StructField("validation_file", T.StringType()),
        T.StructField("training_file", T.StringType()),
        T.StructField("hyperparameters", T.StructType([
            T.StructField("n_epochs", T.LongType()),
            T.StructField("batch_size", T.LongType()),
            T.StructField("learning_rate_multiplier", T.DoubleType()),
        ])),
        T.StructField("trained_tokens", T.LongType()),
        T.StructField("error", T.StringType()),
    ])),
    T.StructField("file", T.StructType([
        T.StructField("object", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("purpose", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("status_details", T.StringType()),
    ])),
])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt round over as many partitions as the session option names; unset, the scan's splits stay.

    For CPU-heavy text work over a few small files (one row group is one
    split); at scale the scan has splits enough and the option stays unset.
    """
    from lisible.session import INPUT_PARTITIONS
    n = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(n)) if n else df


def documents(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """Documents to score; an optional language predicate is pushed to the scan."""
    df = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    if lang is not None:
        df = df.where(F.col("lang") == lang)
    return spread(df)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def scan_articles(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Read an article table with the fixed schema.

    JSON (a records array on one line, or JSON lines) is the import/export
    form; malformed records land in ``_corrupt_record`` instead of failing
    the scan.
    """
    if fmt == "json":
        schema = T.StructType(ARTICLE_SCHEMA.fields + [T.StructField("_corrupt_record", T.StringType(), True)])
        return (spark.read.schema(schema).option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    return spark.read.schema(ARTICLE_SCHEMA).parquet(path)


def scan_simplifications(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Read a table of versions with the fixed schema; malformed JSON records land in ``_corrupt_record``."""
    if fmt == "json":
        schema = T.StructType(SIMPLIFICATION_SCHEMA.fields + [T.StructField("_corrupt_record", T.StringType(), True)])
        return (spark.read.schema(schema).option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    return spark.read.schema(SIMPLIFICATION_SCHEMA).parquet(path)


def quarantine(scanned: DataFrame, path: str, batch: int) -> DataFrame:
    """The sound rows of a scan; corrupt records are written to ``path`` as the batch's own partition.

    The scan is written once first: a corrupt-record column alone cannot be read from the raw file again.
    """
    from lisible.session import materialize
    rows = materialize(scanned, "scan")
    (rows.where("_corrupt_record is not null").select(F.col("_corrupt_record").alias("record"), F.lit("corrupt").alias("reason"),
                                                      F.lit(batch).cast("bigint").alias("batch"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path))
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def scan_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Stored table if present, else an empty one with the fixed schema."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(hpath):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def model_registry(spark: SparkSession, path: str) -> DataFrame:
    """One row per base model from a folder of fine-tuning JSON documents.

    When several files name the same base model the later file (by name)
    wins; ``registry_order`` gives the deterministic listing order.
    """
    raw = (spark.read.schema(REGISTRY_SCHEMA).option("multiLine", True).json(path)
           .select(F.col("model.model").alias("model"),
                   F.col("model.fine_tuned_model").alias("fine_tuned_model"),
                   F.col("_metadata.file_name").alias("file_name")))
    latest = raw.groupBy("model").agg(F.max_by("fine_tuned_model", "file_name").alias("fine_tuned_model"),
                                      F.max("file_name").alias("file_name"))
    # listing order: how many registry files come before (the registry is a folder of a handful of files)
    before = latest.select(F.col("file_name").alias("_f")).distinct()
    order = F.size(F.filter(F.sort_array("_files"), lambda f: f < F.col("file_name"))).cast("int")
    files = before.agg(F.collect_set("_f").alias("_files")).scalar()
    return latest.withColumn("_files", files).withColumn("registry_order", order).drop("_files")
