import itertools
import struct

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lisible.llm import pieces, wfst


@pytest.fixture(scope="module")
def models():
    with open(pieces.MODEL, "rb") as f:
        return wfst.compile_model(f.read()), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_equals_the_tokenizer_library(models):
    mine, theirs = models

    @settings(max_examples=1500, deadline=None)
    @given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["the", "in", "ing", "er", " ", "  ", "tion", "=", "--", "é", "☃", "\n", "▁"]), max_size=20).map("".join)))
    def check(text):
        if "\x00" in text:
            return
        ids = mine.encode(text)
        assert ids == theirs.encode(text)
        assert mine.decode(ids) == text.replace("▁", " ")

    check()


def test_small_cache_changes_nothing(models):
    mine, theirs = models
    small = wfst.Machine(mine.pieces, mine.model_type, cache_bytes=700, cache_pairs=3)
    text = "the quick brown fox jumps over the lazy dog the quick " * 5
    assert small.encode(text) == theirs.encode(text)


def test_unigram_path_is_the_shortest():
    listed = [("a", -1.0, 1), ("b", -1.5, 1), ("ab", -2.0, 1), ("ba", -1.2, 1), ("aba", -4.0, 1), ("▁", -0.5, 1), ("▁a", -1.1, 1), ("<unk>", 0.0, 2)]
    m = wfst.Machine(listed, wfst.UNIGRAM)
    score = {t: s for t, s, _ in listed}

    def brute(text):
        best = None
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(text)]
            parts = [text[x:y] for x, y in zip(at, at[1:])]
            if all(p in m.ids for p in parts):
                total = sum(score[p] for p in parts)
                best = total if best is None else max(best, total)
        return best

    for n in range(1, 8):
        for text in map("".join, itertools.product("ab", repeat=n)):
            got = m.shortest_path("▁" + text)
            assert abs(sum(m.scores[i] for i in got) - brute("▁" + text)) < 1e-9


def test_model_file_is_read(models):
    mine, theirs = models
    assert [p[0] for p in mine.pieces[:300]] == [theirs.id_to_piece(i) for i in range(300)]
    broken = b"\x1a\x05\x12\x03abc" + b"\x12\x02\x18\x02"
    with pytest.raises(ValueError):
        wfst.compile_model(broken)
    assert struct.calcsize("<f") == 4


def test_documents(spark, models):
    data = [(1, "the cat", 7), (1, "the cat", 7), (None, None, 8), (3, "", 9), (4, "x" * 50_000 + " é☃", 1), (5, "a ▁ b", 2)]
    docs = spark.createDataFrame(data, "doc_id long, text string, ids int")
    out = pieces.encode_documents(docs)
    assert out.columns == ["doc_id", "text", "n_ids", "ids", "decoded_sha256", "round_trip"]
    got = out.collect()
    assert len(got) == len(data) and all(r.round_trip for r in got)
    assert all(r.ids == models[1].encode(r.text or "") and r.n_ids == len(r.ids) for r in got)
    back = pieces.decode_documents(out).collect()
    assert sorted(r.decoded for r in back) == sorted((t or "").replace("▁", " ") for _, t, _ in data)
    assert pieces.encode_documents(docs.limit(0)).count() == 0


def test_query_on_whole_table(spark, models):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = pieces.op8_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs) and all(r.ids == models[1].encode(docs[r.doc_id]) for r in got)
