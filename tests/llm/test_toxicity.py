"""Toxicity: training on small sets, misspellings, awkward rows, held-out accuracy on the given tables."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lisible.llm import toxicity as X

SF = "/root/testdata/sf0.1"


def corpus(n=300, seed=3):
    """Invented prose; every third text holds two of the marked words somewhere."""
    r = random.Random(seed)
    syllables = ["ba", "lo", "mi", "ne", "ru", "sta", "pel", "or", "en", "tis"]
    plain = ["".join(r.choice(syllables) for _ in range(r.randrange(2, 5))) for _ in range(200)]
    texts, toxic = [], []
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.choice([15, 60, 300]))]
        if i % 3 == 0:
            for _ in range(2):
                words.insert(r.randrange(len(words)), r.choice(["grumbold", "Fekwitz!", "schnark"]))
        texts.append(" ".join(words))
        toxic.append(int(i % 3 == 0))
    return texts, toxic


def score(model, text):
    return X.Scorer(model).scores([text])[0]


@pytest.fixture(scope="module")
def model():
    return X.train(*corpus())


def test_unseen_texts_are_told_and_long_ones_are_not_diluted(model):
    texts, toxic = corpus(seed=9)
    assert np.mean([(score(model, t) >= 0.5) == bool(y) for t, y in zip(texts, toxic)]) > 0.98
    clean = " ".join(t for t, y in zip(texts, toxic) if not y)
    assert score(model, clean) < 0.5 < score(model, clean + " schnark schnark " + clean)


def test_misspellings_share_subwords(model):
    text = "lomi nerusta {} pelor enba"
    for seen in ("gruumbold", "grumboldd", "fekwittz", "sschnark", "schnarkk"):
        assert score(model, text.format(seen)) > 0.5
    assert score(model, text.format("tisenlo")) < 0.5


def test_training_is_the_same_every_time(model):
    again = X.train(*corpus())
    assert again.bias == model.bias and again.shares == model.shares


def test_score_by_its_definition(model):
    text = "lomi Schnark " + "ba lo neru " * 9
    words = X.words_of(text)
    word = lambda w: np.mean([model.shares.get(int(b), 0.0) for b in X.subwords([w])[0]])
    cuts = [*X.passage_starts(len(words)), len(words)]
    worst = max(np.mean([word(w) for w in words[a:b]]) for a, b in zip(cuts, cuts[1:]))
    assert score(model, text) == pytest.approx(1 / (1 + np.exp(-(model.bias + worst))), abs=1e-12)
    assert score(model, None) == score(model, " ., ") == pytest.approx(1 / (1 + np.exp(-model.bias)))


def test_subwords_do_not_depend_on_their_neighbours():
    words = ["ab", "é", "grumbold", "ab", "aaaaaa", "\U0001d11ex"]
    buckets, owner = X.subwords(words)
    for i, w in enumerate(words):
        alone, _ = X.subwords([w])
        assert sorted(buckets[owner == i].tolist()) == sorted(alone.tolist())
        assert len(alone) == 1 + sum(max(0, len(w) + 3 - n) for n in X.NGRAMS)
    assert set(X.subwords(["ba"])[0].tolist()).isdisjoint(X.subwords(["ab"])[0].tolist())
    assert set(X.subwords(["grumbold"])[0].tolist()) & set(X.subwords(["grumboldt"])[0].tolist())


def test_passages():
    assert list(X.passage_starts(0)) == [0] and list(X.passage_starts(30)) == [0, 12] and list(X.passage_starts(31)) == [0, 12, 24]


def test_one_class_or_none():
    assert score(X.train([], []), "any") == 0.0
    assert score(X.train(["a"], [0]), "any") == 0.0
    assert score(X.train(["a"], [1]), "any") == 1.0
    assert 0 <= score(X.train(["", "a b"], [1, 0]), "a b") <= 1


def write(spark, path, docs, labels):
    spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({c: F.lit("1") for c in ("toxic", "draw", "score")}) \
        .write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, toxic int").withColumns({c: F.lit("1") for c in ("text", "draw")}) \
        .write.parquet(str(path / "labels.parquet"))
    return X.op13_toxicity(spark, str(path))


def test_query_with_awkward_rows(spark, tmp_path):
    texts, toxic = corpus(240)
    docs = [(i, t) for i, t in enumerate(texts)]
    labels = [(i, y) for i, y in enumerate(toxic)]
    docs += [(1, texts[1]), (None, texts[0]), (900, None), (901, ""), (902, "!!"), (903, "lomi " * 30000), (904, "x" * 50000)]
    labels += [(0, 0), (2, None), (3, 7), (None, 1), (900, 1), (9999, 1), (0, 1)]
    told = write(spark, tmp_path, docs, labels)
    assert told.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = told.collect()
    assert sorted(repr(r["doc_id"]) for r in rows) == sorted(repr(d) for d, _ in docs)
    by_id = {r["doc_id"]: r for r in rows}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert by_id[None]["score"] == by_id[0]["score"] and by_id[900]["score"] == by_id[901]["score"] == by_id[902]["score"]
    held = [r for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 240]
    assert len(held) > 20 and np.mean([r["predicted"] == toxic[r["doc_id"]] for r in held]) > 0.95


def test_held_out_labels_are_not_learned(spark, tmp_path):
    texts, toxic = corpus(240)
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(240)]
    scores = []
    for flip in (False, True):
        told = write(spark, tmp_path / str(flip), list(enumerate(texts)), [(i, 1 - y if flip and h else y) for i, (y, h) in enumerate(zip(toxic, held))])
        scores.append(sorted(tuple(r) for r in told.collect()))
    assert scores[0] == scores[1]


def test_empty_tables(spark, tmp_path):
    assert write(spark, tmp_path / "a", [], []).collect() == []
    assert [r["score"] for r in write(spark, tmp_path / "b", [(1, "a")], []).collect()] == [0.0]


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = X.op13_toxicity(spark, SF).where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    hit = np.mean([r["predicted"] for r in rows if r["toxic"] == 1])
    false = np.mean([r["predicted"] for r in rows if r["toxic"] == 0])
    assert hit > 0.6 and false < 0.1
