"""Simpler words learned from the corpus: hard words and the easier words found in like contexts.

Words are described by the frequent words around them (positive pointwise
mutual information, sparse rows). Random hyperplanes give every word a
signature; words are ordered by each band of its bits and compared with the
``NEIGHBOURS`` next ones in that order, by ranks, so the work is linear in the
vocabulary and no bucket gathers in one task. Candidates are confirmed by the
cosine of their rows. A hard word (at least ``HARD_LETTERS`` letters) may be
replaced by an easier, more frequent one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lisible.constants import LIX_LONG_WORD
from lisible.functions.text import WORD, sentence_array
from lisible.operators.catalog import assign_dense_ids
from lisible.operators.joins import salted_join
from lisible.operators.simplify import OUTPUT_COLUMNS, Generator
from lisible.session import materialize

#: A word needs so many occurrences; contexts are the most frequent words.
MIN_COUNT, CONTEXTS, WINDOW = 8, 400, 2
BANDS, BITS, NEIGHBOURS = 4, 12, 10
HARD_LETTERS = LIX_LONG_WORD
MIN_SIMILARITY = 0.35


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("(" + WORD + ")"), 1)).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _counted_pairs(contexts: list[str]):
    """Batches of word arrays -> (word, context, k): pairs within WINDOW, counted in the batch before they are shuffled."""
    reach = WINDOW

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        table = pa.array(contexts, pa.string())
        width = max(len(contexts), 1)
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten().cast(pa.string())
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            sentence = np.repeat(np.arange(len(sizes)), sizes)
            coded = flat.dictionary_encode()
            word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            context = pc.fill_null(pc.index_in(flat, value_set=table), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = []
            for d in range(1, reach + 1):
                near = sentence[d:] == sentence[:-d]
                for one, other in ((word[:-d], context[d:]), (word[d:], context[:-d])):
                    kept = near & (other >= 0)
                    keys.append(one[kept] * width + other[kept])
            found, times = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary.take(pa.array(found // width)), table.take(pa.array(found % width)), pa.array(times.astype(np.int64))], ["word", "context", "k"])
    return run


def _dots():
    """(contexts, weights, contexts, weights) -> double: inner products of sparse rows."""
    @F.arrow_udf("double")
    def dot(a: pa.Array, x: pa.Array, b: pa.Array, y: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow.compute as pc
        n = len(a)
        names = pa.concat_arrays([a.flatten().cast(pa.string()), b.flatten().cast(pa.string())]).dictionary_encode()
        codes, width = names.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(names.dictionary), 1)
        row = lambda lists: np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        of_a, of_b = row(a), row(b)
        left, right = of_a * width + codes[:len(of_a)], of_b * width + codes[len(of_a):]
        _, at, to = np.intersect1d(left, right, assume_unique=True, return_indices=True)
        made = x.flatten().to_numpy(zero_copy_only=False)[at] * y.flatten().to_numpy(zero_copy_only=False)[to]
        return pa.array(np.bincount(of_a[at], weights=made, minlength=n).astype(float))
    return dot


def context_weights(docs: DataFrame, counts: DataFrame, text: str = "text") -> DataFrame:
    """``(word, context, weight)``: positive PMI of words with MIN_COUNT occurrences and frequent words within WINDOW of them in a sentence."""
    contexts = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(CONTEXTS).select("word").collect()]   # CONTEXTS rows
    sentences = docs.select(F.explode(sentence_array(F.col(text))).alias("s"))
    words = sentences.select(F.regexp_extract_all(F.lower("s"), F.lit("(" + WORD + ")"), 1).alias("w"))
    seen = words.mapInArrow(_counted_pairs(contexts), "word string, context string, k bigint")
    seen = seen.groupBy("word", "context").agg(F.sum("k").alias("k"))
    seen = materialize(seen.join(counts.where(F.col("n") >= MIN_COUNT).select("word"), "word"), "lexical-contexts")
    per_word = seen.groupBy("word").agg(F.sum("k").alias("k_word"))
    per_context = F.broadcast(seen.groupBy("context").agg(F.sum("k").alias("k_context")))  # CONTEXTS rows
    total = seen.select(F.sum("k")).scalar()
    pmi = F.log(F.col("k") * total / (F.col("k_word") * F.col("k_context")))
    return seen.join(per_word, "word").join(per_context, "context").select("word", "context", pmi.alias("weight")).where("weight > 0")


def signatures(weights: DataFrame) -> DataFrame:
    """``(word, norm, bands array<int>)``: signs of the word's row on random hyperplanes, BITS to a band."""
    sign = lambda j: F.when(F.pmod(F.xxhash64("context", F.lit(j)), F.lit(2)) == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    sides = [F.sum(F.col("weight") * sign(j)).alias(f"h{j}") for j in range(BANDS * BITS)]
    rows = weights.groupBy("word").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"), *sides)
    bit = lambda j, i: F.when(F.col(f"h{j}") > 0, F.lit(1 << i)).otherwise(F.lit(0))
    bands = [sum((bit(b * BITS + i, i) for i in range(BITS)), F.lit(0)) for b in range(BANDS)]
    return rows.select("word", "norm", F.array(*bands).alias("bands"))


def candidate_pairs(signed: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Distinct ``(a, b)``: words that are near in the order of a band's bits; both directions."""
    rows = signed.select("word", F.posexplode("bands").alias("band", "bits"))
    ranked = materialize(assign_dense_ids(rows, ["band", "bits", "word"], id_col="rank").select("word", "band", "rank"), "lexical-ranks")
    ahead = ranked.select(F.col("word").alias("a"), "band", F.explode(F.sequence(F.col("rank") + 1, F.col("rank") + F.lit(neighbours))).alias("rank"))
    near = ahead.join(ranked.withColumnRenamed("word", "b"), ["band", "rank"])
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return near.select(F.inline(both)).distinct()


def word_substitutes(docs: DataFrame, text: str = "text", neighbours: int = NEIGHBOURS) -> DataFrame:
    """``(word, substitute, similarity)``: for every hard word the most similar easier and more frequent word, if there is one."""
    counts = materialize(word_counts(docs, text), "lexical-counts")
    weights = materialize(context_weights(docs, counts, text), "lexical-weights")
    signed = materialize(signatures(weights), "lexical-signatures")
    known = counts.where(F.col("n") >= MIN_COUNT)
    hard = F.length("a") >= F.lit(HARD_LETTERS)
    pairs = candidate_pairs(signed, neighbours).where(hard & (F.length("b") < F.lit(HARD_LETTERS)))
    pairs = pairs.join(known.select(F.col("word").alias("a"), F.col("n").alias("n_a")), "a").join(known.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b") \
        .where("n_b > n_a").select("a", "b", "n_b")
    # a word's row has CONTEXTS entries at most and the word a bounded number of neighbours: rows travel whole
    rows = materialize(weights.groupBy("word").agg(F.collect_list(F.struct("context", "weight")).alias("row")), "lexical-rows")
    rows = rows.select("word", F.col("row")["context"].alias("c"), F.col("row")["weight"].alias("w"))
    dot = pairs.join(rows.toDF("a", "ca", "wa"), "a").join(rows.toDF("b", "cb", "wb"), "b") \
        .select("a", "b", "n_b", _dots()("ca", "wa", "cb", "wb").alias("dot")).where("dot > 0")
    norms = signed.select("word", "norm")
    cosine = dot.join(norms.toDF("a", "na"), "a").join(norms.toDF("b", "nb"), "b").withColumn("similarity", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 6))
    best = cosine.where(F.col("similarity") >= MIN_SIMILARITY).groupBy("a").agg(F.max_by(F.struct("b", "similarity"), F.struct("similarity", "n_b", "b")).alias("best"))
    return best.select(F.col("a").alias("word"), F.col("best.b").alias("substitute"), F.col("best.similarity").alias("similarity"))


class LexicalGenerator(Generator):
    """Rewrites sentences by replacing hard words; ``substitutes`` is ``(word, substitute)``, one row per word."""

    name = "lexical"

    def __init__(self, substitutes: DataFrame, keys: tuple[str, ...] = ("doc_id", "pos")):
        self.substitutes, self.keys = substitutes.select("word", "substitute"), list(keys)

    def generate(self, prompts: DataFrame) -> DataFrame:
        """Only hard words meet the substitutes, as (key, place, word); they are put back at their places inside the row."""
        base = prompts.drop(*OUTPUT_COLUMNS)
        rows = materialize(base.withColumn("_tokens", F.regexp_extract_all("sentence", F.lit("(" + WORD + "|[^\\p{L}]+)"), 1)), "lexical-tokens")
        asked = rows.select(*self.keys, F.posexplode("_tokens").alias("at", "token")).where((F.length("token") >= HARD_LETTERS) & F.col("token").rlike("^\\p{L}"))
        told = salted_join(asked.withColumn("word", F.lower("token")), self.substitutes, ["word"], salt_from=[*self.keys, "at"])
        told = told.groupBy(*self.keys).agg(F.map_from_entries(F.collect_set(F.struct("at", "substitute"))).alias("_new"))
        j = rows.join(told, self.keys, "left")
        new = F.transform("_tokens", lambda t, i: F.coalesce(_cased(F.try_element_at("_new", i), t), t))
        return j.select(*base.columns, F.array_join(new, "").alias("prediction"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"))


def _cased(word: Column, like: Column) -> Column:
    """The word with a capital where the replaced one has one."""
    upper = like.rlike("^\\p{Lu}")
    return F.when(upper, F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word)))).otherwise(word)
