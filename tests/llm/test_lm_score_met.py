import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lisible.llm import lm_score as lm
from tests.llm.test_lm_score import Plain, corpus, tokens


def odd_rows():
    rows = corpus() + [(-5, "w1 w2 w3 w2", 1), (-(1 << 62), "rare1 rare2 rare1 rare2 w1", 0), ((1 << 63) - 1, "rare1 rare2 new rare1 new", 2)]
    return rows + [(2000 + i, f"alpha{i} beta{i % 9} gamma{i % 4} w{i}", i % 7) for i in range(60)]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, fold int").repartition(3)


@pytest.mark.parametrize("bits,pair_bits,bucket,learned", [(3, 3, 1 << 21, True), (6, 9, 500, True), (8, 20, 97, False), (20, 20, 300, True), (0, 20, 1000, False)])
def test_scores_equal_plain_counting_whatever_is_broadcast(spark, monkeypatch, bits, pair_bits, bucket, learned):
    monkeypatch.setattr(lm, "BUCKET", bucket)
    monkeypatch.setattr(lm, "GROUP", bucket // 9)
    rows = odd_rows()
    docs = docs_of(spark, rows)
    model = lm.train(docs.where(F.col("fold") != 2), lexicon_bits=bits)
    plain = Plain(rows, model.weights, 60)
    assert (model.tokens, model.distinct) == (plain.n, plain.v)
    got = {r.doc_id: r for r in lm.score(docs, model, pair_bits, *[F.col("fold") != 2] * learned).collect()}
    assert len(got) == len(rows)
    for d, t, _ in rows:
        own = tokens(t)
        base = sum(math.log10((plain.c[w] + 1) / (plain.n + plain.v + 1)) for w in own)
        full = sum(math.log10(plain.p(h, w)) for h, w in zip(["<s>", *own], own))
        r = got[d]
        assert (r.n_tokens, r.n_known) == (len(own), sum(plain.c[w] > 0 for w in own))
        assert abs(r.base_score - base) < 1e-9 * abs(base) and abs(r.score - full) < 1e-9 * abs(full)


def test_weights_do_not_depend_on_what_is_broadcast(spark, monkeypatch):
    docs = docs_of(spark, odd_rows()).where(F.col("fold") != 2)
    weights = [lm.train(docs, lexicon_bits=bits).weights for bits in (0, 4, 20)]
    monkeypatch.setattr(lm, "BUCKET", 150)
    weights += [lm.train(docs, lexicon_bits=4).weights, lm.train(docs, 30, 20).weights]
    for other in weights[1:]:
        assert np.allclose(weights[0], other, atol=1e-12)


def test_ids_that_repeat_or_are_null_add_up(spark):
    rows = [(1, "a b a b c", 0), (1, "a b x", 0), (None, "c a", 3), (None, "a b a b", 6), (2, "b y y y y", 2), (0, "c a", 2)]
    docs = docs_of(spark, rows)
    for bits in (0, 2, 20):
        model = lm.train(docs.where(F.col("fold") != 2), lexicon_bits=bits)
        once = {r.doc_id: r for r in lm.score(docs, model, learned=F.col("fold") != 2).collect()}
        apart = {r.doc_id: r for r in lm.score(docs, model).collect()}
        plain = Plain(rows, model.weights, 60)
        assert once.keys() == apart.keys() == {0, 1, 2, None}
        for d in once:
            own = [tokens(t) for i, t, _ in rows if i == d]
            full = sum(math.log10(plain.p(h, w)) for t in own for h, w in zip(["<s>", *t], t))
            assert once[d].n_tokens == apart[d].n_tokens == sum(map(len, own))
            assert abs(once[d].score - full) < 1e-9 * abs(full) and abs(apart[d].score - full) < 1e-9 * abs(full)


def test_integers_pack_and_unpack():
    for values in ([], [0], [255, 256, 0], [2**64 - 1, 2**63, 1], [2**40, 3]):
        values = np.array(values, np.uint64)
        assert (lm._unpack(lm._pack(values)) == values).all() and len(lm._pack(values)) <= 1 + 8 * len(values)


def test_what_travels_per_token_is_small():
    """The scored tokens of a text leave in at most 14 bytes each, where rows of eleven columns took over 60."""
    rng = np.random.default_rng(5)
    tokens = lm.mix(rng.zipf(1.3, 200_000).astype(np.uint64))
    per = np.full(400, 500)
    hashes, counts = np.unique(tokens, return_counts=True)
    often = counts > 4
    known = lm.Counts(hashes[often], counts[often], np.ones(int(often.sum()), dtype=bool), True, len(tokens), 0, 0, 400)
    lexicon = lm.Lexicon.of(known, known, 20)
    context, word, before = lexicon.numbered(tokens, per)
    owner, other = lexicon.owners(context, word, before, tokens)
    ones = np.ones(len(tokens), dtype=bool)
    rows = list(lm._block(4, owner, other, ones, ~ones, np.repeat(np.arange(400), per), np.zeros(len(tokens), np.uint8)))
    assert sum(lm._unpack(r["times"]).sum() for r in rows) == len(tokens)
    assert sum(len(v) for r in rows for v in r.values() if isinstance(v, bytes)) <= 14 * len(tokens)
