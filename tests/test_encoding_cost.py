"""Prompts are tokenized once, rows are told apart by number, and ids meet their batch in one join."""

from lisible.operators import simplify as sp
from lisible.plans import simplify as Q


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rare_tokens_of_rows_without_a_key_or_with_the_same(spark, monkeypatch):
    rows = [(None, 0, "un deux trois"), (None, 0, "trois quatre"), (1, 0, "deux"), (1, 0, "un un cinq"), (2, 0, ""), (3, 0, None)]
    texts = spark.createDataFrame(rows, "doc_id long, pos int, formatted_chat string")
    vocab = sp.vocabulary(texts).where("token <> 'cinq'")
    ids = {r["token"]: r["token_id"] for r in vocab.collect()}
    want = sorted([sp.BOS_ID, *(ids.get(t, sp.UNK_ID) for t in x.split())] for _, _, x in rows if x is not None)
    for share in (1, 10**9):   # every token rare, every token frequent
        monkeypatch.setattr(sp, "FREQUENT_SHARE", share)
        assert sorted(r["ids"] for r in sp.encode_prompts(texts, vocab).collect()) == want


def test_ids_meet_their_batch_once(spark):
    enc = spark.createDataFrame([(i, 0, list(range(i % 5 + 1))) for i in range(12)], "doc_id long, pos int, ids array<bigint>")
    b = sp.generation_batches(enc, batch_size=4)
    assert _plan(b).count("Join ") == 2   # offsets of the ranks (a row per partition), and the ids
    assert sorted((r["batch_id"], r["batch_len"], r["n_ids"]) for r in b.collect())[::4] == [(0, 2, 1), (1, 3, 2), (2, 5, 4)]


def test_sentences_are_tokenized_before_they_are_stored(spark, tmp_path):
    spark.createDataFrame([(1, "Une phrase. Une autre.", "fr")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    lv = sp.with_sentence_tokens(Q.levels(spark, str(tmp_path)))
    assert [r["tokens"] for r in lv.orderBy("pos").collect()] == [["Une", "phrase", "."], ["Une", "autre", "."]]
    stored = lv.select("doc_id", "pos", "difficulty", "tokens")   # the sentence itself is not asked for again
    vocab = sp.template_vocabulary(stored)
    assert sorted(map(tuple, vocab.collect())) == sorted(map(tuple, sp.template_vocabulary(lv.drop("tokens")).collect()))
    ids = {r["pos"]: r["ids"] for r in sp.encode_template_prompts(stored, vocab).collect()}
    assert ids == {r["pos"]: r["ids"] for r in sp.encode_template_prompts(lv.drop("tokens"), vocab).collect()}
