"""Sentence difficulty scorers and per-document averages.

A scorer turns a table with a ``sentence`` column into the same table
with six probability columns A1..C2. The default is a native readability
stand-in evaluated entirely in JVM expressions; model-backed scorers plug in
through ``mapInPandas`` with the same contract.
"""

from __future__ import annotations

from typing import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lisible.constants import FLOAT_DECIMALS, LEVELS, SCORER_MAX_TOKENS
from lisible.functions.levels import dominant_level, probability_arrays, with_level_probabilities
from lisible.functions.text import sentence_array, token_count, within_tokens


class Scorer:
    """``DataFrame(sentence, ...) -> DataFrame(..., A1..C2)``."""

    def score(self, df: DataFrame, sentence: str = "sentence") -> DataFrame:  # pragma: no cover
        raise NotImplementedError

    def arrays(self, sentences: Column) -> Column | None:
        """array<string> -> array<array<double>> if the scorer is native, else None."""
        return None


class LixScorer(Scorer):
    """Readability index per sentence mapped to six level probabilities by a softmax.

    Not a CEFR model: it only reproduces the shape of the output (six
    probabilities in level order summing to one).
    """

    def arrays(self, sentences: Column) -> Column:
        return probability_arrays(sentences)

    def score(self, df: DataFrame, sentence: str = "sentence") -> DataFrame:
        return with_level_probabilities(df, sentence)


class PandasModelScorer(Scorer):
    """Scorer backed by a per-batch Python model (e.g. an ONNX session).

    ``load`` is called once per Python worker to open the model lazily;
    ``predict(model, list[str]) -> array (n, 6)`` returns probabilities in
    level order. Rows travel in Arrow batches through ``mapInPandas``.
    """

    def __init__(self, load: Callable[[], object], predict: Callable[[object, list], object]):
        self._load = load
        self._predict = predict

    def score(self, df: DataFrame, sentence: str = "sentence") -> DataFrame:
        load, predict = self._load, self._predict
        out_schema = T.StructType(df.schema.fields + [T.StructField(lv, T.DoubleType()) for lv in LEVELS])

        def run(batches: Iterator):
            import numpy as np
            model = None
            for pdf in batches:
                if model is None:
                    model = load()
                probs = np.asarray(predict(model, pdf[sentence].tolist()), dtype="float64")
                for i, lv in enumerate(LEVELS):
                    pdf[lv] = probs[:, i] if len(pdf) else []
                yield pdf

        return df.mapInPandas(run, out_schema)


DEFAULT_SCORER = LixScorer()


def sentence_difficulty(sents: DataFrame, scorer: Scorer = DEFAULT_SCORER) -> DataFrame:
    return scorer.score(sents)


def doc_difficulty(scored_sents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Arithmetic mean of each level over a document's sentences.

    A hash aggregate with map-side partial averaging: a document's sentences
    sit next to each other after the explode, so the shuffle carries about
    one partial row per document and partition, whatever the skew.
    """
    return scored_sents.groupBy(key).agg(*[F.avg(lv).alias(lv) for lv in LEVELS])


def scored_documents(docs: DataFrame, key: str = "doc_id", text: str = "text",
                     scorer: Scorer = DEFAULT_SCORER,
                     max_tokens: int = SCORER_MAX_TOKENS) -> DataFrame:
    """Split → length filter → score → mean, per document row.

    With a native scorer the whole chain stays inside the row (array
    higher-order functions), so there is no explode and no shuffle at all.
    Documents with no scorable sentence (null texts too) get null levels and ``n_sentences=0``.
    A model scorer goes through the sentence table and ``doc_difficulty``.
    """
    sents = sentence_array(F.coalesce(F.col(text), F.lit("")))   # a null text has no sentence, like an empty one
    kept = F.filter(sents, lambda s: within_tokens(s, max_tokens))
    if scorer.arrays(F.array()) is None:
        from lisible.operators.sentences import sentences, short_sentences
        table = short_sentences(sentences(docs.select(key, text), key=key, text=text), max_tokens)
        stats = scorer.score(table).groupBy(key).agg(
            F.count(F.lit(1)).alias("n_sentences"), *[F.avg(lv).alias(lv) for lv in LEVELS])
        return docs.join(stats, key, "left").fillna({"n_sentences": 0})

    staged = docs.withColumn("_kept", kept)
    staged = staged.withColumn("_probs", scorer.arrays(F.col("_kept")))
    zero = F.array(*[F.lit(0.0) for _ in LEVELS])
    staged = staged.withColumn("_sums", F.aggregate(
        "_probs", zero, lambda acc, p: F.zip_with(acc, p, lambda a, b: a + b)))
    n = F.size("_kept")
    means = [F.when(n > 0, F.col("_sums")[i] / n) for i in range(len(LEVELS))]
    result = F.struct(n.alias("n_sentences"), *[m.alias(lv) for m, lv in zip(means, LEVELS)])
    # emitted through a one-row generator: a later filter on the results (e.g. n_sentences > 0)
    # cannot be pushed below it, so the sentence work is never duplicated into a pushed predicate
    return staged.select(*docs.columns, F.inline(F.array(result)))


def rounded_levels() -> list[Column]:
    return [F.round(F.col(lv), FLOAT_DECIMALS).alias(lv) for lv in LEVELS]


def with_dominant_level(df: DataFrame, name: str = "level") -> DataFrame:
    return df.withColumn(name, dominant_level())


# surface features shared by the learned scorer
def sentence_features(df: DataFrame, sentence: str = "sentence") -> DataFrame:
    from lisible.constants import LIX_LONG_WORD
    from lisible.functions.text import long_word_count, word_count
    words = word_count(F.col(sentence))
    return df.withColumns({
        "_f_words": words.cast("double"),
        "_f_long": (long_word_count(F.col(sentence), LIX_LONG_WORD) / F.greatest(words, F.lit(1))).cast("double"),
        "_f_chars": (F.length(sentence) / F.greatest(words, F.lit(1))).cast("double"),
        "_f_tokens": token_count(F.col(sentence)).cast("double"),
    })


FEATURES = ["_f_words", "_f_long", "_f_chars", "_f_tokens"]


def fit_level_model(labeled: DataFrame, sentence: str = "sentence", level: str = "level", max_iter: int = 50):
    """Multinomial logistic regression from labelled sentences (``level`` in A1..C2) — a spark.ml pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from lisible.functions.levels import level_rank
    data = sentence_features(labeled, sentence).withColumn("_label", level_rank(F.col(level)).cast("double"))
    pipe = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="_features"),
                            LogisticRegression(featuresCol="_features", labelCol="_label", family="multinomial",
                                               maxIter=max_iter, probabilityCol="_probability",
                                               rawPredictionCol="_raw", predictionCol="_prediction")])
    return pipe.fit(data)


class LearnedScorer(Scorer):
    """Scores with a fitted level model; class ``i`` of the model is level ``LEVELS[i]``.

    Levels never seen in training get probability 0.
    """

    def __init__(self, model):
        self.model = model

    def score(self, df: DataFrame, sentence: str = "sentence") -> DataFrame:
        from pyspark.ml.functions import vector_to_array
        out = self.model.transform(sentence_features(df, sentence))
        probs = vector_to_array(F.col("_probability"))
        n = F.size(probs)
        cols = [F.when(F.lit(i) < n, probs[i]).otherwise(F.lit(0.0)).alias(lv) for i, lv in enumerate(LEVELS)]
        return out.select(*df.columns, *cols)
