"""Stored forms of the catalog: answers equal to the direct jobs, and reads in proportion to what is asked."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from lisible.constants import LEVELS
from lisible.operators import catalog as cat
from lisible.operators import catalog_store as store
from lisible.session import scratch_path

SCHEMA = "article_id long, url string, title string, text string, " + ", ".join(f"{lv} double" for lv in LEVELS)


def index(spark, urls):
    name = f"url_index_{uuid.uuid4().hex[:12]}"
    path = scratch_path(spark, "test-index")
    store.open_url_index(spark, name, path, buckets=8)
    store.add_urls(spark.createDataFrame([(u,) for u in urls], "url string"), name)
    return name, path


def test_index_equals_the_direct_join_over_several_batches(spark):
    rng = random.Random(3)
    known = ["https://a/1", "text", None, "https://a/1"]
    name, path = index(spark, known)
    for n in range(3):
        rows = [(100 * n + i, rng.choice([None, "text", *[f"https://a/{k}" for k in range(12)]]), i) for i in range(40)]
        batch = spark.createDataFrame(rows, "page_id long, url string, n int")
        catalog = spark.createDataFrame([(u,) for u in known], "url string")
        want = sorted(map(repr, cat.new_urls(batch, catalog).collect()))
        got = store.new_urls_indexed(batch, name)
        assert got.columns == batch.columns and sorted(map(repr, got.collect())) == want
        store.add_urls(got.select("url"), name)
        known += [r["url"] for r in got.collect()]
    # opened again under another name, as after a restart
    store.open_url_index(spark, name + "b", path, buckets=8)
    assert {r["url"] for r in spark.table(name + "b").collect()} == {u for u in known if u and u != "text"}


def test_check_moves_the_batch_only(spark):
    name, _ = index(spark, [f"https://a/{i}" for i in range(50)])
    batch = spark.createDataFrame([(i, f"https://a/{i}") for i in range(40, 60)], "page_id long, url string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = store.new_urls_indexed(batch, name)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "LeftAnti" in plan
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    lines = plan.splitlines()
    at = lines.index(scan)
    above, level = [], depth(scan)
    for line in reversed(lines[:at]):
        if depth(line) < level:
            above.append(line)
            level = depth(line)
        if "LeftAnti" in line:
            break
    assert "SelectedBucketsCount: 8 out of 8" in scan and not any("Exchange" in line for line in above)


def articles(spark, rows):
    return spark.createDataFrame([(i, u, t, x, *([1 / 6] * 5 + [1 / 6 if ok else 0.5])) for i, u, t, x, ok in rows], SCHEMA)


@pytest.mark.parametrize("rows", [
    [(i, f"https://a/{i % 40}", "t", "x", True) for i in range(50)],
    [(0, "text", None, "x", True), (0, "text", "t", None, False), (40000, "https://a", "t", "x", True), (5, "https://a", "t", "x", True)],
    [(-3, "text", "t", "x", True), (None, "text", "t", "x", True), (70000, "u", "t", "x", True)],
    []])
def test_merged_audit_equals_the_direct_one(spark, rows):
    df, path = articles(spark, rows), scratch_path(spark, "test-audit")
    for b in range(3):
        store.write_audit_part(df.where(F.pmod(F.coalesce("article_id", F.lit(0)), F.lit(3)) == b), path, b)
    store.write_audit_part(df.where(F.pmod(F.coalesce("article_id", F.lit(0)), F.lit(3)) == 1), path, 1)  # a batch written again replaces its part
    want, got = cat.catalog_audit(df).first().asDict(), store.merged_audit(spark, path).first().asDict()
    assert got == want
    plan = store.merged_audit(spark, path)._jdf.queryExecution().optimizedPlan().toString()
    assert "count(distinct" not in plan.lower() and "title#" not in plan


def test_pages_open_the_files_that_hold_them(spark):
    ids = [i for i in range(400) if i % 7]
    cards = spark.createDataFrame([(i, f"t{i}") for i in ids], "article_id long, title string").repartition(5)
    path = scratch_path(spark, "test-cards")
    store.write_cards(cards, path, files=8)
    after, seen = -1, []
    while True:
        page = store.listing_page(spark, path, after, 20)
        assert len(store.page_files(spark, path, after, 20)) <= 2
        rows = page.collect()
        if not rows:
            break
        assert len(rows) == 20 or rows[-1]["article_id"] == ids[-1]
        seen += [r["article_id"] for r in rows]
        after = seen[-1]
    assert seen == ids
    assert [r["article_id"] for r in store.listing_page(spark, path, 395, 20).collect()] == [396, 397, 398]
    empty = scratch_path(spark, "test-cards")
    store.write_cards(cards.limit(0), empty)
    assert store.listing_page(spark, empty).collect() == []
