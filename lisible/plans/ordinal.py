"""Queries of the fitted ordinal level model.

The given tables have no CEFR labels, so the labels are stand-ins and say so:
the documents whose ``labels.quality`` is 1 are ranked by their mean readability
level and cut into six parts of equal size, A1 the easiest; every sentence
carries the part of its whole document. Folds go by document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lisible.constants import FLOAT_DECIMALS, LEVELS
from lisible.operators import ordinal as O
from lisible.operators import sentences as sn
from lisible.operators.catalog import scorable
from lisible.operators.scoring import rounded_levels, scored_documents
from lisible.plans.memo import memoized
from lisible.session import materialize
from lisible.sources.tables import documents, read_table


@memoized
def features(spark, sf_dir) -> DataFrame:
    good = read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    docs = documents(spark, sf_dir).select("doc_id", "text").join(good, "doc_id", "left_semi")
    mean = sum((F.lit(i) * F.col(lv) for i, lv in enumerate(LEVELS)), F.lit(0.0))
    level = materialize(scorable(scored_documents(docs)).select("doc_id", "text", mean.alias("mean")), "ordinal-documents")
    cuts = level.select(F.percentile_approx("mean", [(i + 1) / len(LEVELS) for i in range(len(LEVELS) - 1)], 100_000)).first()[0]  # five numbers
    rank = sum(((F.col("mean") > c).cast("int") for c in cuts or []), F.lit(0))
    level = level.select("doc_id", "text", rank.alias("rank"))
    # three of five documents train, one calibrates, one is held out
    fold = F.array(*[F.lit(f) for f in (0, 0, 0, 1, 2)])[F.pmod(F.col("doc_id"), F.lit(5)).cast("int")]
    rows = level.select("doc_id", "rank", fold.alias("fold"), F.explode(sn.sentence_array(F.col("text"))).alias("sentence"))
    return O.labelled_features(rows)


@memoized
def model(spark, sf_dir) -> O.OrdinalModel:
    return O.fit_ordinal(features(spark, sf_dir))


def q_level_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds, weights, temperature and held-out log loss of the fitted model, by name."""
    m = model(spark, sf_dir)
    told = O.held_out_loss(features(spark, sf_dir), m)
    rows = [(f"threshold_{lv}", t) for lv, t in zip(LEVELS, m.thresholds)] + list(zip([f"weight_{f}" for f in O.FEATURES], m.weights)) \
        + [("temperature", m.temperature)] + [(f"held_out_{k}", float(v)) for k, v in told.items()]
    return spark.createDataFrame([(k, round(float(v), FLOAT_DECIMALS)) for k, v in rows], "name string, value double")


def q_ordinal_articles(spark, sf_dir):
    """Every document scored by the fitted model: mean probabilities over its sentences, inside the row."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = scorable(scored_documents(docs, scorer=O.OrdinalScorer(model(spark, sf_dir))))
    return scored.select("doc_id", F.col("n_sentences").cast("bigint").alias("n_sentences"), *rounded_levels())


QUERIES = {
    "level_model": q_level_model,
    "ordinal_articles": q_ordinal_articles,
}


def oracle() -> dict[str, str]:
    """Newton steps have no SQL form; ``tests/test_ordinal.py`` holds them against a plain solver."""
    return {}
