"""Corpus pipeline: each stage is written as Parquet and read again as the next one's documents.

Every stage but the last returns the columns of ``documents``: documents whose
language is not told go, one document of each group of near duplicates stays,
documents that hold a benchmark item go, personal data is masked in the text,
and the last stage adds the piece ids of the sanitised text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lisible.llm import decontaminate, language_id, near_dup, pieces, pii
from lisible.llm.common import read
from lisible.session import scratch_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.filter_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("personal_data", personal_data), ("pieces", piece_ids)]

#: Compression sizes, link components and lattice paths have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
