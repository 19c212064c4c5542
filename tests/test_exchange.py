"""Requests and responses as two streams: duplicates, late and lost responses, new attempts, restarts."""

import datetime as dt

from pyspark.sql import functions as F

from lisible.operators.simplify import FileExchangeGenerator
from lisible.session import scratch_path
from lisible.streaming import exchange as X

START = dt.datetime(2024, 1, 1)
at = lambda minutes: START + dt.timedelta(minutes=minutes)


class Service:
    def __init__(self, spark):
        self.spark, self.base = spark, scratch_path(spark, "test-exchange")
        spark.createDataFrame([], X.ASKED_SCHEMA).write.parquet(f"{self.base}/requests")
        spark.createDataFrame([], X.ANSWER_SCHEMA).write.parquet(f"{self.base}/responses")

    def ask(self, *rows):
        self.spark.createDataFrame(rows, X.ASKED_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.base}/requests")

    def answer(self, *rows):
        self.spark.createDataFrame(rows, X.ANSWER_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.base}/responses")

    def run(self, now=0):
        clock = F.lit(at(now))
        X.start_exchange(self.spark, f"{self.base}/requests", f"{self.base}/responses", f"{self.base}/results", f"{self.base}/ckpt", clock=clock).awaitTermination()
        return self.rows()

    def rows(self):
        return sorted((r["doc_id"], r["attempt"], r["status"], r["prediction"]) for r in X.read_results(self.spark, f"{self.base}/results").collect())


def test_lost_late_and_repeated_responses(spark):
    s = Service(spark)
    s.ask(*[(i, 0, 0, f"s{i}", at(i)) for i in range(5)], (1, 0, 0, "s1", at(1)))
    s.answer((0, 0, 0, " p0 ", None, at(3)), (0, 0, 0, "other", None, at(4)), (1, 0, 0, None, "failed", at(5)))
    first = s.run()
    assert first == [(0, 0, "ok", "p0"), (1, 0, "error", "s1")]
    assert s.run() == first  # a restart without anything new
    # time goes on by another request and response; 2 and 3 were never answered, 4 is answered after its hour
    s.ask((90, 0, 0, "s90", at(200)))
    s.answer((4, 0, 0, "p4", None, at(100)), (90, 0, 0, "p90", None, at(201)))
    told = s.run(now=205)
    assert told == sorted(first + [(90, 0, "ok", "p90"), (2, 0, "expired", "s2"), (3, 0, "expired", "s3"), (4, 0, "expired", "s4")])
    # the expired ones are asked again; a late answer to the first attempt does not count for the second
    asked = spark.read.parquet(f"{s.base}/requests").where("attempt = 1").collect()
    assert sorted((r["doc_id"], r["sentence"], r["asked_at"]) for r in asked) == [(i, f"s{i}", at(205)) for i in (2, 3, 4)]
    s.answer((2, 0, 0, "too late", None, at(206)), (2, 0, 1, "p2", None, at(206)), (3, 0, 1, "p3", None, at(207)), (3, 0, 1, "p3", None, at(207)))
    told = s.run(now=210)
    assert [r for r in told if r[1] == 1] == [(2, 1, "ok", "p2"), (3, 1, "ok", "p3")]
    final = {r["doc_id"]: (r["status"], r["prediction"]) for r in X.final_predictions(X.read_results(spark, f"{s.base}/results")).collect()}
    assert final == {0: ("ok", "p0"), 1: ("error", "s1"), 2: ("ok", "p2"), 3: ("ok", "p3"), 4: ("expired", "s4"), 90: ("ok", "p90")}


def test_all_answered_equals_the_file_exchange(spark):
    s = Service(spark)
    s.ask(*[(i, i % 3, 0, f"sentence {i}", at(i % 7)) for i in range(40)])
    answers = [(i, i % 3, 0, None if i % 9 == 4 else f" p{i} ", "no" if i % 9 == 4 else None, at(i % 7 + 2)) for i in range(40)]
    s.answer(*answers[:25])
    s.answer(*answers[25:], *answers[20:30])
    s.run()
    prompts = spark.createDataFrame([(i, i % 3, f"sentence {i}") for i in range(40)], "doc_id long, pos long, sentence string")
    path = scratch_path(spark, "test-file-exchange")
    spark.createDataFrame([(a, b, p, e) for a, b, _, p, e, _ in answers], "doc_id long, pos long, prediction string, error string").write.json(path)
    want = {(r["doc_id"], r["pos"]): (r["prediction"], r["status"]) for r in FileExchangeGenerator("unused", path).generate(prompts).collect()}
    got = {(r["doc_id"], r["pos"]): (r["prediction"], r["status"]) for r in X.read_results(spark, f"{s.base}/results").collect()}
    assert got == want and X.read_results(spark, f"{s.base}/results").count() == 40
