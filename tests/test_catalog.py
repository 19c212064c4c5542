"""Catalog jobs: dense ids, lookups, audit, de-duplication of submissions."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lisible.operators import catalog as cat


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_dense_ids_partition_invariant(spark, parts):
    df = spark.range(0, 500).select((F.col("id") * 7 % 1000).alias("key"), F.lit("x").alias("v"))
    out = cat.assign_dense_ids(df, "key", id_col="rid", base=10, partitions=parts).collect()
    got = sorted((r["key"], r["rid"]) for r in out)
    assert [rid for _, rid in got] == list(range(10, 510))


def test_dense_ids_base_from_table(spark):
    df = spark.range(3).select(F.col("id").alias("k"))
    base = spark.range(5).agg((F.max("id") + 1).alias("next"))
    assert sorted(r["article_id"] for r in cat.assign_dense_ids(df, "k", base=base).collect()) == [5, 6, 7]


def test_ordinal_within_equals_row_number(spark):
    df = spark.range(0, 300).select((F.col("id") % 3).alias("g"), (F.col("id") * 13 % 301).alias("s"))
    got = {(r["g"], r["s"]): r["ordinal"] for r in cat.ordinal_within(df, "g", "s").collect()}
    w = Window.partitionBy("g").orderBy("s")
    exp = {(r["g"], r["s"]): r["rn"] for r in df.withColumn("rn", F.row_number().over(w) - 1).collect()}
    assert got == exp


def test_new_urls_first_in_batch_and_not_known(spark):
    batch = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, "u1"), (4, "u3")], "seq long, url string")
    known = spark.createDataFrame([("u3",), ("text",)], "url string")
    assert sorted((r["seq"], r["url"]) for r in cat.new_urls(batch, known, order_by="seq").collect()) == [(1, "u1"), (2, "u2")]


def test_article_by_id_route_cast(spark):
    arts = spark.createDataFrame([(0, "t0", "text"), (1, "t1", "text")], "article_id long, title string, url string")
    req = spark.createDataFrame([("1",), ("x",), ("9",), (" 0 ",)], "route string")
    got = {r["route"]: (r["article_id"], r["found"]) for r in cat.article_by_id(arts, req).collect()}
    assert got == {"1": (1, True), "x": (-1, False), "9": (9, False), " 0 ": (0, True)}


def test_audit_flags(spark):
    from lisible.constants import LEVELS
    schema = "article_id long, url string, title string, text string, " + ", ".join(f"{l} double" for l in LEVELS)
    z = (0.0,) * 4
    rows = [(0, "u", "a", "x", 1.0, *z, 0.0), (1, "u", None, "y", 0.5, *z, 0.0), (3, "text", "c", "z", 0.0, *z, 1.0)]
    a = cat.catalog_audit(spark.createDataFrame(rows, schema)).first()
    assert (a["n_rows"], a["ids_dense"], a["null_titles"], a["duplicate_urls"], a["bad_probability_sums"]) == (3, False, 1, 1, 1)
