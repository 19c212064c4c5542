"""The pipeline against plain code, stage by stage in one pass over a small table."""

import math
import os

import pyarrow as pa
import pyarrow.parquet as pq
import sentencepiece

import corpus_pipeline
import test_pii
from lisible.llm import language_id, pieces, pii
from lisible.session import scratch_path


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_dup(rows):
    sets = [shingle_set(r["text"]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(r["doc_id"], least.get(find(i), r["doc_id"]))
    return [r for i, r in enumerate(rows) if not sets[i] or least[find(i)] == r["doc_id"]]


def decontaminated(rows, items):
    sets = [s for s in map(shingle_set, items) if s]
    return [r for r in rows if not any(100 * len(s & shingle_set(r["text"])) >= 80 * len(s) for s in sets)]


def sanitised(rows):
    """The rows with base spans masked and terms that reveal an entity generalised or removed; and the terms of each."""
    terms = test_pii.plain_terms([r["text"] for r in rows])
    out = [{**r, "text": None if r["text"] is None else pii.redacted(r["text"], [dict(zip(("start", "stop", "action"), t)) for t in own])}
           for r, own in zip(rows, terms)]
    return out, terms


def test_pipeline_equals_plain_code(spark):
    source = "/root/testdata/sf0.001"
    table = pq.read_table(f"{source}/documents.parquet")
    rows = table.to_pylist()
    extra = [(9000, None), (9001, ""), (9002, "12 34 %%"), (9003, rows[3]["text"]), (9004, rows[4]["text"] + " tail")]
    extra += [(9100 + i, f"Ask Zebulon Quark by mail zq@example.com about {'the ' * i}offer.\n" + rows[20 + i]["text"][: len(rows[20 + i]["text"]) // 3]) for i in range(5)]
    rows += [{**rows[0], "doc_id": i, "text": t, "lang": "en"} for i, t in extra]
    base = scratch_path(spark, "test-pipeline").removeprefix("file:")
    os.makedirs(base)
    pq.write_table(pa.Table.from_pylist(rows, schema=table.schema), f"{base}/documents.parquet")
    items = pq.read_table(f"{source}/benchmark.parquet")
    pq.write_table(items, f"{base}/benchmark.parquet")

    docs = spark.read.parquet(f"{base}/documents.parquet")
    encoders = language_id.Encoders(language_id.learn(language_id.labelled(docs))[0])
    want = [r for r in rows if not encoders.predict(r["text"])[2]]
    assert {9000, 9001, 9002}.isdisjoint(r["doc_id"] for r in want) and len(want) >= len(rows) - 6
    want = near_dup(want)
    assert 9003 not in {r["doc_id"] for r in want}
    want = decontaminated(want, [i["text"] for i in items.to_pylist()])
    want, terms = sanitised(want)
    assert any(terms)
    tokenizer = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, base).collect()}
    assert sorted(got) == sorted(r["doc_id"] for r in want)
    for r in want:
        g = got[r["doc_id"]]
        assert all(g[c] == r[c] for c in table.column_names), r["doc_id"]
        assert list(g.ids) == tokenizer.encode(r["text"]) and g.n_ids == len(g.ids) and g.round_trip
    assert "zq@example.com" not in got[9100].text and "Zebulon" not in got[9100].text


def test_stages_keep_columns_and_take_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, _row string, c1 int"
    docs = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.count() == 0
        if name != "pieces":
            assert out.columns == docs.columns
    one = spark.createDataFrame([(1, "der die das und ist nicht ein Satz", "de", "s", 5, 0.1, "r", 2), (2, "the one and only of that is in", "en", "s", 5, 0.1, "r", 2)], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, one, "/root/testdata/sf0.001")
        assert out.columns == one.columns and sorted(map(str, out.collect())) == sorted(map(str, one.collect())), name
