"""Contexts are counted before the shuffle, neighbours are joined once, and words' rows travel whole."""

import pyarrow as pa

from lisible.operators import lexical as L


def test_contexts_are_counted_in_the_batch():
    lists = pa.array([["le", "chat", "le", "chien"], [], None, ["chat"], ["le", "le"]], pa.list_(pa.string()))
    got = {}
    for b in L._counted_pairs(["le", "rare"])([pa.RecordBatch.from_arrays([lists.slice(i, 4)], ["w"]) for i in (0, 4)]):
        assert b.schema.names == ["word", "context", "k"]
        for r in b.to_pylist():
            got[r["word"], r["context"]] = got.get((r["word"], r["context"]), 0) + r["k"]
    # le-chat, chat-le, chien-le, chien... two apart: le-le, chat-chien
    assert got == {("chat", "le"): 2, ("chien", "le"): 1, ("le", "le"): 4}


def test_neighbours_are_joined_once(spark):
    signed = spark.createDataFrame([(f"w{i}", 1.0, [i, 50 - i]) for i in range(20)], "word string, norm double, bands array<int>")
    pairs = L.candidate_pairs(signed, 2)
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1   # for both directions
    got = {(r["a"], r["b"]) for r in pairs.collect()}
    assert got == {(b, a) for a, b in got} and ("w0", "w1") in got and ("w0", "w2") in got


def test_dots_of_sparse_rows(spark):
    rows = [(["a", "b"], [1.0, 2.0], ["b", "c", "a"], [3.0, 9.0, 5.0]), (["a"], [1.0], ["b"], [1.0]), ([], [], ["a"], [1.0])]
    df = spark.createDataFrame(rows, "a array<string>, x array<double>, b array<string>, y array<double>").repartition(1)
    assert sorted(r["d"] for r in df.select(L._dots()("a", "x", "b", "y").alias("d")).collect()) == [0.0, 0.0, 11.0]
