"""The fitted ordinal model against a plain solver, numeric derivatives and its own native scorer."""

import numpy as np
import pytest

from lisible.constants import LEVELS
from lisible.operators import ordinal as O


def data(n=4000, seed=2):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, 5)) * [1, 2, 0.5, 3, 1] + [0, 5, 1, -2, 0]
    score = x @ [0.8, -0.4, 1.1, 0.3, 0.0] + g.logistic(size=n)
    return x, np.searchsorted([-4.5, -3, -2, -1, 0.5], score).astype(np.int32)


def table(spark, x, y, fold=None):
    fold = np.arange(len(y)) % 3 if fold is None else fold
    rows = [(int(a), int(f), [float(v) for v in r]) for r, a, f in zip(x, y, fold)]
    return spark.createDataFrame(rows, "y int, fold int, x array<double>").repartition(4)


def test_derivatives_equal_differences():
    x, y = data(60)
    params = np.array([-3.0, -1, 0.2, 1, 2.5, 0.3, -0.2, 0.1, 0.5, -0.4])
    loss = lambda p: O.statistics(x, y, p[:5], p[5:], 1.3)
    _, gradient, hessian = loss(params)
    for i in range(10):
        e = np.zeros(10)
        e[i] = 1e-5
        assert gradient[i] == pytest.approx((loss(params + e)[0] - loss(params - e)[0]) / 2e-5, rel=1e-4, abs=1e-4)
        assert np.allclose(hessian[i], (loss(params + e)[1] - loss(params - e)[1]) / 2e-5, rtol=1e-4, atol=1e-3)


def test_fit_equals_a_plain_solver(spark):
    x, y = data()
    m = O.fit_ordinal(table(spark, x, y))
    own = np.arange(len(y)) % 3 == 0
    mean, scale = x[own].mean(axis=0), x[own].std(axis=0)
    z, n = (x[own] - mean) / scale, own.sum()
    # plain gradient descent with a numeric line search, no Newton step
    p = np.concatenate([np.linspace(-1, 1, 5), np.zeros(5)])
    f = lambda p: O.statistics(z, y[own], p[:5], p[5:])[0] + 0.5 * O.RIDGE * n * p @ p if (np.diff(p[:5]) > 0).all() else np.inf
    for _ in range(4000):
        g = O.statistics(z, y[own], p[:5], p[5:])[1] + O.RIDGE * n * p
        size = 4.0 / n
        while f(p - size * g) > f(p) - 0.3 * size * g @ g and size > 1e-12:
            size /= 2
        p = p - size * g
    assert np.allclose(m.thresholds + m.weights, p, atol=2e-3)
    assert np.allclose(m.mean, mean) and np.allclose(m.scale, scale) and 0.8 < m.temperature < 1.25


def test_held_out_loss_and_probabilities(spark):
    x, y = data()
    t = table(spark, x, y)
    m = O.fit_ordinal(t)
    told = O.held_out_loss(t, m)
    own = np.arange(len(y)) % 3 == 2
    p = m.probabilities(x[own])
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    assert told["log_loss"] == pytest.approx(-np.log(p[np.arange(own.sum()), y[own]]).mean())
    assert told["rows"] == own.sum() and told["log_loss"] < 0.9 * told["base_log_loss"]


def test_levels_without_rows_and_one_level_only(spark):
    x, y = data(600)
    m = O.fit_ordinal(table(spark, x, np.where(y == 2, 3, y)))
    assert (np.diff(m.thresholds) > 0).all() and np.isfinite(m.weights).all()
    assert m.probabilities(x).shape == (600, 6) and m.probabilities(x)[:, 2].max() < 0.05
    one = O.fit_ordinal(table(spark, x, np.zeros(600, int)))
    assert one.probabilities(x)[:, 0].mean() > 0.9
    with pytest.raises(ValueError):
        O.fit_ordinal(table(spark, x[:3], y[:3], np.array([2, 2, 2])))


def test_native_scorer_equals_the_model(spark):
    texts = ["Court.", "Une phrase un peu plus longue, avec des mots extraordinaires; et une suite.", "", "a b c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, sentence string")
    m = O.OrdinalModel([1, .2, 4, 1, .1], [1, 2, 1, .5, 1], [-2, -1, 0, 1, 2], [.5, 1, -.3, .2, 2], 1.2)
    x = [r["x"] for r in sorted(O.labelled_features(df.selectExpr("sentence", "0 as rank", "i as fold")).collect(), key=lambda r: r["fold"])]
    want = m.probabilities(np.array(x))
    scorer = O.OrdinalScorer(m)
    got = [[r[lv] for lv in LEVELS] for r in sorted(scorer.score(df).collect(), key=lambda r: r["i"])]
    assert np.allclose(got, want)
    in_row = [r["a"][0] for r in df.select("i", scorer.arrays(O.F.array("sentence")).alias("a")).orderBy("i").collect()]
    assert np.allclose(in_row, want)


def test_queries_beat_the_level_shares(spark):
    from lisible.plans import ordinal as P
    sf = "/root/testdata/sf0.01"
    told = {r["name"]: r["value"] for r in P.q_level_model(spark, sf).collect()}
    assert told["held_out_log_loss"] < told["held_out_base_log_loss"]
    rows = P.q_ordinal_articles(spark, sf).collect()
    assert all(abs(sum(r[lv] for lv in LEVELS) - 1) < 1e-5 for r in rows) and len(rows) > 900
