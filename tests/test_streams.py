"""Streaming ingest: equals the batch plan, and a replay with the same checkpoint adds nothing."""

import os
import shutil
import tempfile

from lisible.session import scratch_path
from lisible.streaming.ingest import read_catalog, start_ingest

SF = "/root/testdata/sf0.001"


def test_ingest_stream_once_and_replay(spark):
    src = tempfile.mkdtemp(prefix="lisible-src-")
    shutil.copy(os.path.join(SF, "pages.parquet"), os.path.join(src, "part-0.parquet"))
    base = scratch_path(spark, "test-ingest")
    q = start_ingest(spark, src, f"{base}/catalog", f"{base}/ckpt")
    q.awaitTermination()
    first = sorted((r["article_id"], r["page_id"]) for r in read_catalog(spark, f"{base}/catalog").collect())
    assert [a for a, _ in first] == list(range(len(first))) and len(first) > 0
    # replay: same checkpoint, no new files → nothing new
    q = start_ingest(spark, src, f"{base}/catalog", f"{base}/ckpt")
    q.awaitTermination()
    again = sorted((r["article_id"], r["page_id"]) for r in read_catalog(spark, f"{base}/catalog").collect())
    assert again == first
    # the same pages arriving again as a new file are all known URLs → no new rows
    shutil.copy(os.path.join(SF, "pages.parquet"), os.path.join(src, "part-1.parquet"))
    q = start_ingest(spark, src, f"{base}/catalog", f"{base}/ckpt")
    q.awaitTermination()
    assert sorted((r["article_id"], r["page_id"]) for r in read_catalog(spark, f"{base}/catalog").collect()) == first


def test_templates_accumulate_across_batches(spark):
    import pyarrow as pa
    import pyarrow.parquet as pq
    src = tempfile.mkdtemp(prefix="lisible-src-")

    def write(name, ids):
        rows = [(i, f"https://one.example/{i}",
                 f"<body><div>Join the club today</div><p>Story number {i} is here.</p></body>") for i in ids]
        pq.write_table(pa.table({"page_id": [r[0] for r in rows], "url": [r[1] for r in rows],
                                 "html": [r[2] for r in rows]}), os.path.join(src, name))

    write("a.parquet", [0, 1, 2])
    base = scratch_path(spark, "test-templates")
    start_ingest(spark, src, f"{base}/catalog", f"{base}/ckpt").awaitTermination()
    write("b.parquet", [3, 4, 5])
    start_ingest(spark, src, f"{base}/catalog", f"{base}/ckpt").awaitTermination()
    texts = {r["page_id"]: r["text"] for r in read_catalog(spark, f"{base}/catalog").collect()}
    assert sorted(texts) == [0, 1, 2, 3, 4, 5]
    assert all("Join the club" in texts[i] for i in (0, 1, 2))       # three pages: not yet a template
    assert not any("Join the club" in texts[i] for i in (3, 4, 5))   # six pages seen: template removed


def test_simplify_stream_two_batches_and_replay(spark):
    from lisible.constants import LEVELS
    from lisible.operators import simplify as sp
    from lisible.streaming.simplify import VERSION_SCHEMA, read_refused, start_simplify
    schema = "article_id long, title string, text string, " + ", ".join(f"{l} double" for l in LEVELS)
    arts = spark.createDataFrame([(0, "t0", "Un chat (noir) dort ; il ronfle. Fin.") + (1 / 6,) * 6,
                                  (1, "t1", "Deux chiens jouent.") + (1 / 6,) * 6], schema)
    initial = spark.createDataFrame([(0, 0)], "article_id long, simplification_id long")
    src = tempfile.mkdtemp(prefix="lisible-req-")
    base = scratch_path(spark, "test-simplify-stream")
    reg = sp.generator_registry(spark)

    def run():
        start_simplify(spark, src, f"{base}/versions", f"{base}/ckpt", arts, initial, reg).awaitTermination()
        return sorted((r["article_id"], r["simplification_id"], r["model"])
                      for r in spark.read.schema(VERSION_SCHEMA).parquet(f"{base}/versions").collect())

    spark.createDataFrame([(0, 1, None, 0), (1, 0, "rule-rewrite-keep", 1)], "article_id long, n long, model string, seq long") \
        .write.mode("append").parquet(src)
    first = run()
    assert first == [(0, 1, "rule-rewrite:v1"), (1, 0, "rule-rewrite-keep:v1")]
    spark.createDataFrame([(0, 2, "rule-rewrite-keep", 2), (1, 0, None, 3)], "article_id long, n long, model string, seq long") \
        .write.mode("append").parquet(src)
    second = run()
    # article 0 already has 0 (initial) and 1 (batch 1): only 2 is new; article 1 ordinal 0 exists
    assert second == sorted(first + [(0, 2, "rule-rewrite-keep:v1")])
    assert run() == second   # replay with the same checkpoint: nothing new
    # requests that cannot be served are kept with their reason, the others go on
    odd = [(0, -1, None, 4), (0, None, None, 5), (1, 1, "no-such-model", 6), (7, 0, None, 7), (7, -2, "no-such-model", 8), (1, 1, None, 9)]
    spark.createDataFrame(odd, "article_id long, n long, model string, seq long").write.mode("append").parquet(src)
    assert run() == sorted(second + [(1, 1, "rule-rewrite:v1")])
    refused = {r["seq"]: r["reason"] for r in read_refused(spark, f"{base}/versions").collect()}
    assert refused == {4: "invalid_ordinal", 5: "invalid_ordinal", 6: "unknown_model", 7: "unknown_article", 8: "invalid_ordinal"}
    assert run() and read_refused(spark, f"{base}/versions").count() == 5


def test_state_read_per_batch_does_not_grow(spark):
    """Five batches over the same blocks: every batch reads one snapshot of the same size, and rejects add up."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from lisible.streaming.ingest import BLOCK_STATS_SCHEMA, latest_snapshot, read_rejected
    src = tempfile.mkdtemp(prefix="lisible-src-")
    base = scratch_path(spark, "test-state")
    for n in range(5):
        rows = [(10 * n + i, f"https://one.example/{10 * n + i}", None if i == 2 else "<body><div>Join us</div><p>The same story.</p></body>") for i in range(4)]
        rows.append((10 * n + 9, "https://one.example/0", "<p>Known url.</p>"))
        pq.write_table(pa.table({"page_id": [r[0] for r in rows], "url": [r[1] for r in rows], "html": pa.array([r[2] for r in rows], pa.string())}), os.path.join(src, f"{n}.parquet"))
        start_ingest(spark, src, f"{base}/catalog", f"{base}/ckpt").awaitTermination()
    sizes = [latest_snapshot(spark, f"{base}/catalog_state/blocks", BLOCK_STATS_SCHEMA, e).count() for e in range(1, 6)]
    assert sizes == [2] * 5
    total = latest_snapshot(spark, f"{base}/catalog_state/blocks", BLOCK_STATS_SCHEMA, 5)
    assert {r["n_pages"] for r in total.collect()} == {15}
    accepted = [r["page_id"] for r in read_catalog(spark, f"{base}/catalog").collect()]
    rejected = {r["page_id"]: r["reason"] for r in read_rejected(spark, f"{base}/catalog").collect()}
    assert sorted(accepted + list(rejected)) == sorted(10 * n + i for n in range(5) for i in (0, 1, 2, 3, 9))
    assert {rejected[10 * n + 2] for n in range(5)} == {"fetch_failed"} and rejected[19] == "known_url"
