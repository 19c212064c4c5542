"""Partition-count invariance, encoding splice property, golden card values."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import digest  # noqa: E402

from lisible.constants import DESCRIPTION_LENGTH, LEVELS, TITLE_LENGTH  # noqa: E402
from lisible.operators import catalog as cat  # noqa: E402
from lisible.operators import simplify as sp  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["scored_articles", "page_main_text", "simplification_ordinals", "new_urls"])
def test_same_result_for_any_shuffle_partitions(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    hashes = set()
    try:
        for n in (1, 4, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            df = E.queries()[name](spark, SF)
            hashes.add(digest(df.columns, [tuple(r) for r in df.collect()])[0])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(hashes) == 1


def test_template_encoding_equals_full_encoding(spark):
    sentences = ["Le 3e étage.", "«Bonjour» dit-il.", "42 ans", '"Citation" finale', "l'été; puis (rien)", "Ça va?"]
    levels = sp.sentence_levels(spark.createDataFrame([(1, i, s) for i, s in enumerate(sentences)],
                                                      "doc_id long, pos int, sentence string"))
    vocab_full = sp.vocabulary(sp.simplification_prompts(levels))
    vocab_tmpl = sp.template_vocabulary(levels)
    assert sorted(tuple(r) for r in vocab_full.collect()) == sorted(tuple(r) for r in vocab_tmpl.collect())
    full = {(r["doc_id"], r["pos"]): r["ids"] for r in sp.encode_prompts(sp.simplification_prompts(levels), vocab_full).collect()}
    tmpl = {(r["doc_id"], r["pos"]): r["ids"] for r in sp.encode_template_prompts(levels, vocab_tmpl).collect()}
    assert full == tmpl


def test_golden_card(spark):
    """The sample stored article: 1,662 characters, percentages 2/6/18/37/24/13, level B2, one minute."""
    text = ("Une phrase d'exemple assez ordinaire pour remplir le texte. " * 40)[:1662]
    probs = [0.02, 0.06, 0.18, 0.37, 0.24, 0.13]
    from lisible.functions.text import clip
    row = spark.createDataFrame([(0, text, *probs)], "article_id long, text string, " + ", ".join(f"{l} double" for l in LEVELS))
    row = row.select("article_id", clip(F.col("text"), TITLE_LENGTH).alias("title"), F.lit(None).cast("string").alias("image"),
                     clip(F.col("text"), DESCRIPTION_LENGTH).alias("description"), "text", *LEVELS)
    card = cat.article_cards(row).first()
    assert card["title"] == text[:60] + "..." and card["description"] == text[:300] + "..."
    assert (card["level"], card["minutes"], card["band"]) == ("B2", 1, 1)
    pct = {r["level"]: r["pct"] for r in cat.level_percentages(row).collect()}
    assert [pct[lv] for lv in LEVELS] == [2.0, 6.0, 18.0, 37.0, 24.0, 13.0]
