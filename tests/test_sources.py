"""Sources and sinks: JSON records array, corrupt records, empty tables, idempotent appends, salted joins."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from lisible.constants import LEVELS
from lisible.operators.joins import salted_join
from lisible.sources.sinks import append_articles, export_json, init_catalog
from lisible.sources.tables import ARTICLE_SCHEMA, scan_articles, scan_or_empty


def _article(i, url="text"):
    rec = {"article_id": i, "url": url, "title": f"t{i}", "image": None, "description": "d", "text": "Un texte."}
    rec.update({lv: 1.0 / 6 for lv in LEVELS})
    return rec


def test_scan_records_array_on_one_line(spark):
    d = tempfile.mkdtemp(prefix="lisible-json-")
    with open(os.path.join(d, "articles.json"), "w") as fh:
        fh.write(json.dumps([_article(0), _article(1, "https://x.example/a")]))
    with open(os.path.join(d, "broken.json"), "w") as fh:
        fh.write("{not json\n")
    rows = scan_articles(spark, d).collect()
    good = sorted(r["article_id"] for r in rows if r["_corrupt_record"] is None)
    assert good == [0, 1]
    assert sum(r["_corrupt_record"] is not None for r in rows) == 1


def test_export_then_scan_round_trip(spark):
    d = tempfile.mkdtemp(prefix="lisible-export-")
    df = spark.createDataFrame([tuple(_article(i).values()) for i in range(3)], ARTICLE_SCHEMA)
    export_json(df, d)
    back = scan_articles(spark, d).where(F.col("_corrupt_record").isNull())
    assert sorted(r["article_id"] for r in back.collect()) == [0, 1, 2]


def test_missing_table_is_empty_and_init_is_idempotent(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="lisible-cat-"), "catalog")
    assert scan_or_empty(spark, d, ARTICLE_SCHEMA).count() == 0
    init_catalog(spark, d)
    init_catalog(spark, d)
    assert spark.read.parquet(d).count() == 0


def test_append_batch_replay_overwrites_only_its_partition(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="lisible-app-"), "catalog")
    rows = lambda ids: spark.createDataFrame([tuple(_article(i).values()) for i in ids], ARTICLE_SCHEMA)
    append_articles(rows([0, 1]), d, batch=0)
    append_articles(rows([2]), d, batch=1)
    append_articles(rows([2]), d, batch=1)   # replay of batch 1
    assert sorted(r["article_id"] for r in spark.read.parquet(d).collect()) == [0, 1, 2]


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_salted_join_equals_plain_join_on_hot_key(spark, how):
    big = spark.range(3000).select((F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50)).alias("k"),
                                   F.col("id"))
    small = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    plain = sorted(tuple(r) for r in big.join(small, "k", how).collect())
    salted = sorted(tuple(r) for r in salted_join(big, small, ["k"], how, salt_from=["id"], buckets=8, rows=100).collect())
    assert salted == plain


def test_predictions_are_stored_and_read_back(spark):
    from lisible.session import scratch_path
    from lisible.sources.sinks import append_predictions, scan_predictions
    path = scratch_path(spark, "test-predictions")
    schema = "doc_id long, pos int, prediction string, status string, error string"
    first = spark.createDataFrame([(1, 0, "a", "ok", None), (1, 1, "x", "error", "boom")], schema)
    append_predictions(first, path, run=0)
    append_predictions(spark.createDataFrame([(1, 1, "b", "ok", None)], schema), path, run=1)
    append_predictions(first, path, run=0)   # the repeated run replaces only its own rows
    assert sorted(tuple(r) for r in scan_predictions(spark, path).collect()) == [(1, 0, "a"), (1, 1, "b")]


def test_versions_are_appended_by_batch(spark):
    from lisible.session import scratch_path
    from lisible.sources.sinks import append_simplifications
    path = scratch_path(spark, "test-versions")
    schema = "article_id long, simplification_id int, model string, title string, text string, " + ", ".join(f"{lv} double" for lv in LEVELS)
    rows = lambda ids: spark.createDataFrame([(i, 0, "m", "t", "x", *[1 / 6] * 6) for i in ids], schema)
    append_simplifications(rows([0, 1]), path, batch=0)
    append_simplifications(rows([2]), path, batch=1)
    append_simplifications(rows([2]), path, batch=1)
    assert sorted(r["article_id"] for r in spark.read.parquet(path).collect()) == [0, 1, 2]


def test_corrupt_versions_go_to_quarantine(spark):
    from lisible.session import scratch_path
    from lisible.sources.tables import quarantine, scan_simplifications
    d = tempfile.mkdtemp(prefix="lisible-versions-")
    good = {"article_id": 1, "simplification_id": 0, "model": "m", "title": "t", "text": "x", **{lv: 1 / 6 for lv in LEVELS}}
    with open(os.path.join(d, "versions.json"), "w") as fh:
        fh.write(json.dumps(good) + "\n{broken\n")
    path = scratch_path(spark, "test-quarantine")
    rows = quarantine(scan_simplifications(spark, d), path, batch=0)
    assert [r["article_id"] for r in rows.collect()] == [1] and rows.columns == ["article_id", "simplification_id", "model", "title", "text", *LEVELS]
    assert [(r["record"], r["reason"]) for r in spark.read.parquet(path).collect()] == [("{broken", "corrupt")]
