"""The exchange's state and shuffles hold keys and times; texts meet in slices when a batch is written."""

import datetime as dt
import os
import random

import pytest

from lisible.streaming import exchange as X

START = dt.datetime(2024, 1, 1)
at = lambda minutes: START + dt.timedelta(minutes=minutes)


def _bytes(folder):
    return sum(os.path.getsize(f"{d}/{n}") for d, _, names in os.walk(folder) for n in names)


def _run(spark, base, asked, answered):
    spark.createDataFrame(asked, X.ASKED_SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/requests")
    spark.createDataFrame(answered, X.ANSWER_SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/responses")
    X.start_exchange(spark, f"{base}/requests", f"{base}/responses", f"{base}/results", f"{base}/ckpt", attempts=1).awaitTermination()
    return sorted((r["doc_id"], r["pos"], r["sentence"], r["prediction"], r["status"], r["error"]) for r in X.read_results(spark, f"{base}/results").collect())


def _rows(n, text):
    """Some answers are lost, some fail, some come twice; requests come twice."""
    asked = [(i, i % 3, 0, text(i), at(i % 5)) for i in range(n)]
    answered = [(i, i % 3, 0, None if i % 9 == 4 else f" p{text(i)} ", "no" if i % 9 == 4 else None, at(i % 5 + 2)) for i in range(n) if i % 7]
    late = ((-1, 0, 0, "", at(10**6)), (-1, 0, 0, "", None, at(10**6)))   # lets the time of all others pass
    want = [(i, i % 3, text(i), "p" + text(i) if i % 7 and i % 9 != 4 else text(i), "expired" if not i % 7 else "error" if i % 9 == 4 else "ok",
             "no" if i % 7 and i % 9 == 4 else None) for i in range(n)]
    return [*asked, *asked[:5], late[0]], [*answered, *answered[:5], late[1]], [(-1, 0, "", "", "ok", None), *want]


def test_state_holds_no_text(spark, tmp_path):
    rng = random.Random(1)
    texts = [rng.randbytes(4000).hex() for _ in range(100)]
    asked, answered, want = _rows(100, texts.__getitem__)
    assert _run(spark, tmp_path, asked, answered) == want
    assert _bytes(f"{tmp_path}/ckpt/state") < 200_000 < _bytes(f"{tmp_path}/requests")   # 400,000 bytes of chance


@pytest.mark.parametrize("rows", [10, 10**6])
def test_slices_give_every_row_once(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(X, "SLICE_ROWS", rows)
    left = [(99, 0, 0, "old", at(0), "old", "ok", None, 0)]   # of a try of the first batch that did not end
    spark.createDataFrame(left, X.RESULT_SCHEMA).write.partitionBy("batch").parquet(f"{tmp_path}/results")
    asked, answered, want = _rows(60, lambda i: f"s{i}")
    assert _run(spark, tmp_path, asked, answered) == want
