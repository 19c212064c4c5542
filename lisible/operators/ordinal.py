"""Ordinal level model: one score per sentence, cut by ordered thresholds (cumulative links), fitted by Newton steps.

``P(level <= k) = sigmoid((threshold_k - weights . features) / temperature)``.
Weights and thresholds come from the likelihood of the training fold: in every
step each task sums gradient, Hessian and loss over its rows and gives out one
row, and these rows are summed position by position. What comes back to the
driver is one array of the parameters' number squared. Steps are halved until
the thresholds stay in order and the loss falls. The temperature is fitted on a
second fold in the same way, so that the probabilities are calibrated on rows
the weights have not seen.

The fitted model scores inside the row in expressions, like the default scorer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lisible.constants import LEVELS, LIX_LONG_WORD
from lisible.functions.text import long_word_count, token_count, word_count
from lisible.operators.scoring import Scorer
from lisible.session import materialize

MAX_STEPS, TOLERANCE, RIDGE = 30, 1e-9, 1e-6


def feature_struct(sentence: Column) -> Column:
    """Surface counts of a sentence, each pattern run once."""
    return F.struct(word_count(sentence).alias("w"), long_word_count(sentence, LIX_LONG_WORD).alias("l"), token_count(sentence).alias("t"),
                    F.regexp_count(sentence, F.lit("[,;:()]")).alias("c"), F.length(sentence).alias("n"))


def feature_array(counts: Column) -> Column:
    words = F.greatest(counts["w"], F.lit(1)).cast("double")
    return F.array(F.log1p(counts["w"].cast("double")), counts["l"] / words, counts["n"] / words,
                   F.log1p(counts["t"].cast("double")), counts["c"] / words)


FEATURES = ["log_words", "long_words", "characters", "log_tokens", "clause_marks"]


def labelled_features(rows: DataFrame, sentence: str = "sentence", label: str = "rank") -> DataFrame:
    """``(y, fold, x)`` of sentences with a label (0, 1, ...) and a fold, as a stored table; features are staged."""
    counts = rows.select(F.col(label).cast("int").alias("y"), "fold", F.inline(F.array(F.struct(feature_struct(F.col(sentence)).alias("c")))))
    return materialize(counts.select("y", "fold", feature_array(F.col("c")).alias("x")), "ordinal-features")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))


def statistics(x: np.ndarray, y: np.ndarray, thresholds: np.ndarray, weights: np.ndarray, temperature: float = 1.0) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood of some rows, its gradient and its Hessian in (thresholds, weights)."""
    k, d = len(thresholds), x.shape[1]
    edge = np.concatenate([[-np.inf], thresholds, [np.inf]])
    s = x @ weights
    up, low = _sigmoid((edge[y + 1] - s) / temperature), _sigmoid((edge[y] - s) / temperature)
    p = np.maximum(up - low, 1e-300)
    du, dl = up * (1 - up) / temperature, low * (1 - low) / temperature
    cu, cl = du * (1 - 2 * up) / temperature, dl * (1 - 2 * low) / temperature
    # derivatives of log p in the upper edge, the lower edge and the score
    gu, gl = du / p, -dl / p
    huu, hll, hul = cu / p - gu * gu, -cl / p - gl * gl, -gu * gl
    jac = np.zeros((len(y), 2, k + d))  # of (upper edge - score, lower edge - score)
    rows = np.arange(len(y))
    has_up, has_low = y < k, y > 0
    jac[rows[has_up], 0, y[has_up]] = 1
    jac[rows[has_low], 1, y[has_low] - 1] = 1
    jac[has_up, 0, k:] = -x[has_up]
    jac[has_low, 1, k:] = -x[has_low]
    gradient = -(gu[:, None] * jac[:, 0] + gl[:, None] * jac[:, 1]).sum(axis=0)
    weighted = np.stack([huu[:, None] * jac[:, 0] + hul[:, None] * jac[:, 1], hul[:, None] * jac[:, 0] + hll[:, None] * jac[:, 1]], axis=1)
    hessian = -np.einsum("nij,nik->jk", weighted, jac)
    return float(-np.log(p).sum()), gradient, hessian


def _totals(features: DataFrame, value, size: int) -> np.ndarray:
    """Sums of ``value(x, y)`` (``size`` numbers) over a stored table: one row per task, then one sum per position."""
    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                total += value(x, batch.column(0).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["part"])

    parts = features.select("y", "x").mapInArrow(run, "part array<double>")
    sums = parts.select(F.posexplode("part").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    out = np.zeros(size)
    for r in sums.collect():  # as many rows as the parameters' number squared
        out[r["at"]] = r["v"]
    return out


@dataclass(frozen=True)
class OrdinalModel:
    mean: list[float]
    scale: list[float]
    thresholds: list[float]
    weights: list[float]
    temperature: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        s = (x - self.mean) / self.scale @ np.array(self.weights)
        cum = _sigmoid((np.array(self.thresholds)[None, :] - s[:, None]) / self.temperature)
        return np.diff(np.concatenate([np.zeros((len(x), 1)), cum, np.ones((len(x), 1))], axis=1), axis=1)


def newton(evaluate, start: np.ndarray, k: int) -> np.ndarray:
    """Minimise by Newton steps; ``evaluate(params) -> (loss, gradient, hessian)``, the first k parameters stay ascending."""
    params = start
    loss, gradient, hessian = evaluate(params)
    for _ in range(MAX_STEPS):
        step = np.linalg.solve(hessian + RIDGE * np.eye(len(params)) * max(1.0, np.trace(hessian) / len(params)), gradient)
        size = 1.0
        while size > 1e-6:
            new = params - size * step
            if (np.diff(new[:k]) > 0).all():
                told = evaluate(new)
                if told[0] <= loss:
                    break
            size /= 2
        else:
            return params
        gain = loss - told[0]
        params, (loss, gradient, hessian) = new, told
        if gain <= TOLERANCE * max(1.0, abs(loss)):
            return params
    return params


def fit_ordinal(features: DataFrame, levels: int = len(LEVELS), train: int = 0, calibrate: int = 1) -> OrdinalModel:
    """Fit on fold ``train`` of a stored table ``(y, fold, x)``, temperature on fold ``calibrate``.

    A level that no training row has gets a threshold as close to its
    neighbour as the ridge lets it come; an empty training fold is an error.
    """
    fold = features.where(F.col("fold") == train)
    d, k = len(FEATURES), levels - 1
    moments = _totals(fold, lambda x, y: np.concatenate([[len(y)], x.sum(axis=0), (x * x).sum(axis=0), np.bincount(y, minlength=levels)]), 1 + 2 * d + levels)
    n = moments[0]
    if not n:
        raise ValueError("no labelled rows to learn from")
    mean = moments[1:1 + d] / n
    scale = np.sqrt(np.maximum(moments[1 + d:1 + 2 * d] / n - mean * mean, 1e-12))
    share = (np.cumsum(moments[1 + 2 * d:]) + 0.5 * np.arange(1, levels + 1)) / (n + 0.5 * levels)
    start = np.concatenate([np.log(share[:-1] / (1 - share[:-1])), np.zeros(d)])
    size = k + d

    def evaluate(params, rows=fold, temperature=1.0):
        def value(x, y):
            loss, gradient, hessian = statistics((x - mean) / scale, y, params[:k], params[k:], temperature)
            return np.concatenate([[loss], gradient, hessian.reshape(-1)])
        t = _totals(rows, value, 1 + size + size * size)
        # a small prior keeps thresholds of unseen levels finite
        return (t[0] + 0.5 * RIDGE * n * float(params @ params), t[1:1 + size] + RIDGE * n * params,
                t[1 + size:].reshape(size, size) + RIDGE * n * np.eye(size))

    params = newton(evaluate, start, k)
    held = features.where(F.col("fold") == calibrate)
    grid = np.exp(np.linspace(-1.5, 1.5, 31))

    def losses(x, y):
        return np.array([statistics((x - mean) / scale, y, params[:k], params[k:], t)[0] for t in grid])
    told = _totals(held, losses, len(grid))
    temperature = float(grid[int(np.argmin(told))]) if told.any() else 1.0
    return OrdinalModel(mean.tolist(), scale.tolist(), params[:k].tolist(), params[k:].tolist(), temperature)


def held_out_loss(features: DataFrame, model: OrdinalModel, fold: int = 2, train: int = 0) -> dict[str, float]:
    """Mean log loss of a fold under the model and under the training fold's level shares."""
    levels = len(model.thresholds) + 1
    counts = _totals(features.where(F.col("fold") == train), lambda x, y: np.bincount(y, minlength=levels).astype(float), levels)
    share = np.maximum(counts, 0.5) / np.maximum(counts, 0.5).sum()

    def value(x, y):
        p = model.probabilities(x)[np.arange(len(y)), y]
        return np.array([len(y), -np.log(np.maximum(p, 1e-300)).sum(), -np.log(share[y]).sum()])
    n, loss, base = _totals(features.where(F.col("fold") == fold), value, 3)
    return {"rows": n, "log_loss": loss / n if n else 0.0, "base_log_loss": base / n if n else 0.0}


class OrdinalScorer(Scorer):
    """Scores sentences with a fitted model, inside the row."""

    def __init__(self, model: OrdinalModel):
        self.model = model

    def _probabilities(self, x: Column) -> Column:
        m = self.model
        score = F.lit(0.0)
        for i, (mean, scale, w) in enumerate(zip(m.mean, m.scale, m.weights)):
            score = score + (x[i] - F.lit(mean)) / F.lit(scale) * F.lit(w)
        return score

    def _levels(self, score: Column) -> Column:
        m = self.model
        cum = [F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(t) - score) / F.lit(m.temperature))) for t in m.thresholds]
        edges = [F.lit(0.0), *cum, F.lit(1.0)]
        return F.array(*[F.greatest(b - a, F.lit(0.0)) for a, b in zip(edges, edges[1:])])

    def arrays(self, sentences: Column) -> Column:
        counts = F.transform(sentences, feature_struct)
        scores = F.transform(F.transform(counts, feature_array), self._probabilities)
        return F.transform(scores, self._levels)

    def score(self, df: DataFrame, sentence: str = "sentence") -> DataFrame:
        out = df.select("*", F.inline(F.array(F.struct(self.arrays(F.array(F.col(sentence)))[0].alias("_levels")))))
        return out.select(*df.columns, *[F.col("_levels")[i].alias(lv) for i, lv in enumerate(LEVELS)])
