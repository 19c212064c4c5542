"""The exchange keeps its state in few stores, and the simulated exchange writes every prompt once."""

import os
import re

from pyspark.sql import functions as F

from lisible.plans import streams
from lisible.streaming import exchange as X


def _files(folder, pattern):
    return [os.path.join(d, n) for d, _, names in os.walk(folder) for n in names if re.search(pattern, n)]


def test_state_is_one_store_per_partition_with_changelogs(spark, tmp_path):
    at = F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id)")
    key = [F.col("id").alias("doc_id"), F.lit(0).cast("bigint").alias("pos"), F.lit(0).alias("attempt")]
    spark.range(20).select(*key, F.lit("s").alias("sentence"), at.alias("asked_at")).write.parquet(f"{tmp_path}/requests")
    spark.range(10).select(*key, F.lit("p").alias("prediction"), F.lit(None).cast("string").alias("error"), at.alias("answered_at")) \
        .write.parquet(f"{tmp_path}/responses")
    X.start_exchange(spark, f"{tmp_path}/requests", f"{tmp_path}/responses", f"{tmp_path}/sink", f"{tmp_path}/ckpt", attempts=1).awaitTermination()
    state = f"{tmp_path}/ckpt/state"
    assert _files(state, r"\.changelog$")
    assert not [d for d, _, _ in os.walk(state) if "keyWithIndexToValue" in d]
    assert X.read_results(spark, f"{tmp_path}/sink").where("status = 'ok'").count() == 10


def test_prompts_are_not_stored_beside_the_requests(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, "Une phrase. Une autre; plus longue.", "fr") for i in range(12)], "doc_id long, text string, lang string") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(streams, "scratch_path", lambda spark, name: f"{tmp_path}/scratch/{name}")
    out = streams.q_generation_stream(spark, str(tmp_path))
    assert out.count() == 24 and out.select("doc_id", "pos").distinct().count() == 24
    assert os.listdir(f"{tmp_path}/scratch") == ["exchange"] and not hasattr(streams, "materialize")
