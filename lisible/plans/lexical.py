"""Queries of lexical substitution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lisible.operators import lexical as L
from lisible.operators.sentences import sentences
from lisible.plans.memo import memoized
from lisible.session import materialize
from lisible.sources.tables import documents


@memoized
def substitutes(spark, sf_dir) -> DataFrame:
    return materialize(L.word_substitutes(documents(spark, sf_dir).select("doc_id", "text")), "word-substitutes")


def q_word_substitutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substitutes(spark, sf_dir)


def q_lexical_sentences(spark, sf_dir):
    """Every sentence with its hard words replaced where the corpus teaches an easier one."""
    made = L.LexicalGenerator(substitutes(spark, sf_dir)).generate(sentences(documents(spark, sf_dir)))
    return made.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "prediction", "status")


QUERIES = {
    "word_substitutes": q_word_substitutes,
    "lexical_sentences": q_lexical_sentences,
}


def oracle() -> dict[str, str]:
    """Hyperplane hashes have no twin in SQL; ``tests/test_lexical.py`` holds the queries against plain code."""
    return {}
