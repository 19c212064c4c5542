import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lisible.llm import lm_score as lm


def corpus(n=260):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(n):
        text, at = [], rng.randrange(120)
        for _ in range(rng.randrange(1, 60)):
            text.append(words[at])
            at = (at * 3 + 1) % 120 if rng.random() < 0.6 else int(120 * rng.random() ** 3)
        rows.append((i, " ".join(text).upper() if rng.random() < 0.2 else "  ".join(text), i % 7))
    return rows + [(1000, None, 2), (1001, "", 3), (1002, "never seen words here", 2), (None, "w1 w2", 2), (1003, "w3 " * 20_000, 2)]


def tokens(text):
    return [*(text or "").encode().lower().split(), "</end>"]


class Plain:
    """The model's probabilities from dictionaries, with the weights that were learned."""

    def __init__(self, rows, weights, context_bits):
        self.c, self.pair, self.ctx = collections.Counter(), collections.Counter(), collections.Counter()
        train = [tokens(t) for _, t, fold in rows if fold != 2]
        for t in train:
            self.c.update(t)
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.grams = {w for w, k in self.c.items() if k * (1 << context_bits) >= self.n}
        self.rare = self.n - sum(self.c[w] for w in self.grams)
        for t in train:
            for h, w in zip(["<s>", *t], t):
                self.pair[self.cls(h), self.cls(w)] += 1
                self.ctx[self.cls(h)] += 1
        self.weights = weights

    def cls(self, w):
        return w if w in self.grams or w == "<s>" else "<rare>"

    def p(self, h, w):
        h, k = self.cls(h), self.cls(w)
        lam = self.weights[int(lm.bucket(np.array([self.ctx[h]]), self.n)[0])]
        two = self.pair[h, k] / self.ctx[h] if self.ctx[h] else 0.0
        if k == "<rare>":
            two *= self.c[w] / max(self.rare, 1)
        return lam[2] * two + lam[1] * self.c[w] / max(self.n, 1) + lam[0] / (self.v + 1)


@pytest.mark.parametrize("bits", [(3, 5, 4), (5, 6, 9), (14, 20, 20)])
def test_scores_equal_plain_counting(spark, bits):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, f, "x") for d, t, f in rows], "doc_id long, text string, fold int, context string").repartition(3)
    model = lm.train(docs.where("fold <> 2").drop("context"), bits[0], bits[1])
    plain = Plain(rows, model.weights, bits[0])
    assert (model.tokens, model.distinct) == (plain.n, plain.v)
    got = {r.doc_id: r for r in lm.score(docs, model, bits[2]).collect()}
    assert len(got) == len(rows)
    for d, t, _ in rows:
        own = tokens(t)
        base = sum(math.log10((plain.c[w] + 1) / (plain.n + plain.v + 1)) for w in own)
        full = sum(math.log10(plain.p(h, w)) for h, w in zip(["<s>", *own], own))
        r = got[d]
        assert (r.n_tokens, r.n_known) == (len(own), sum(plain.c[w] > 0 for w in own))
        assert abs(r.base_score - base) < 1e-6 * abs(base) and abs(r.score - full) < 1e-6 * abs(full)
    for h in ["<s>", "w1", "w100"]:
        h = h.encode() if h != "<s>" else h
        assert abs(sum(plain.p(h, w) for w in plain.c) + plain.p(h, "new") - 1) < 1e-9
    held = [got[d] for d, _, f in rows if f == 2 and d is not None and d < 1000]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + (50 if bits[0] > 5 else 0)


def test_learned_weights_are_the_best(spark):
    cells = [(0, 0.01, 0.2, 0.5, 30.0), (0, 0.01, 0.1, 0.0, 20.0), (0, 0.01, 0.0, 0.0, 5.0), (3, 0.01, 0.3, 0.1, 50.0)]
    weights = lm.learn_weights(cells, rounds=500)

    def likelihood(lam, b):
        return sum(n * math.log(lam[0] * p0 + lam[1] * p1 + lam[2] * p2) for i, p0, p1, p2, n in cells if i == b) + sum(map(math.log, lam))

    for b in (0, 3):
        best = likelihood(weights[b], b)
        for x in range(1, 20):
            for y in range(1, 20 - x):
                assert likelihood((x / 20, y / 20, 1 - (x + y) / 20), b) <= best + 1e-6
    assert np.allclose(weights.sum(axis=1), 1) and (weights > 0).all()


def test_repeated_ids_add_up_and_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "a b", 2), (1, "a", 2), (None, "c", 2)], "doc_id long, text string, fold int")
    got = {r.doc_id: r for r in lm.score(docs, lm.train(docs.where("fold <> 2"))).collect()}
    assert got[1].n_tokens == 5 and got[None].n_tokens == 2
    assert all(r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in got.values())


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, fold int")
    assert lm.score(docs, lm.train(docs)).count() == 0
    some = spark.createDataFrame([(1, "a b a", 0), (2, "b", 6)], "doc_id long, text string, fold int")
    assert lm.score(docs, lm.train(some)).count() == 0
    assert lm.score(some.where(F.col("fold") == 0), lm.train(some)).count() == 1


def test_every_word_is_a_context_however_rare(spark):
    rows = [(i, " ".join(f"x{(i * 7 + j * j) % 400}" for j in range(80)), i % 7) for i in range(600)]
    rows += [(2000 + i, f"alpha{i} beta{i} gamma{i}", (0, 1, 3)[i % 3]) for i in range(40)] + [(3000, "alpha7 beta7 gamma7", 2), (3001, "alpha7 beta8 gamma7", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fold int")
    model = lm.train(docs.where("fold <> 2"))
    assert model.tokens > 1 << 14  # a word seen once is under N / 2**14
    got = {r.doc_id: r for r in lm.score(docs, model).collect()}
    plain = Plain(rows, model.weights, 60)
    for d, t, _ in rows:
        own = tokens(t)
        full = sum(math.log10(plain.p(h, w)) for h, w in zip(["<s>", *own], own))
        assert abs(got[d].score - full) < 1e-6 * abs(full)
    assert got[3000].score > got[3001].score + 0.5 and got[3000].base_score == got[3001].base_score
