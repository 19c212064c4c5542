"""Sentence table, token counts and the abbreviation learner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lisible.constants import SCORER_MAX_TOKENS
from lisible.functions.staged import staged
from lisible.functions.text import sentence_array, token_count
from lisible.operators.joins import salted_join

# tokens for abbreviation learning: a word, internal periods allowed, optional final period
ABBREV_TOKEN = r"[\p{L}]+(?:[.][\p{L}]+)*[.]?"
ABBREV_P1 = 0.99        # P(period | abbreviation) under the alternative hypothesis
ABBREV_THRESHOLD = 0.3  # scaled log-likelihood needed to call a type an abbreviation


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text",
              abbreviations: list[str] | None = None) -> DataFrame:
    """``(key, pos, sentence)`` — one row per sentence, 0-based position kept explicitly."""
    return docs.select(key, F.posexplode(sentence_array(F.col(text), abbreviations)).alias("pos", "sentence"))


def with_token_counts(sents: DataFrame) -> DataFrame:
    return sents.withColumn("n_tokens", token_count(F.col("sentence")))


def short_sentences(sents: DataFrame, max_tokens: int = SCORER_MAX_TOKENS) -> DataFrame:
    """Keep sentences the scorer can take (encoded length within its position count)."""
    # staged: the filter would count the tokens once more below the projection
    return staged(sents, n_tokens=token_count(F.col("sentence"))).where(F.col("n_tokens") <= F.lit(max_tokens))


def learn_abbreviations(docs: DataFrame, text: str = "text",
                        threshold: float = ABBREV_THRESHOLD) -> DataFrame:
    """Type-based abbreviation detection over a corpus (Kiss & Strunk, 2006).

    For each lower-cased word type: how often it carries a final period
    versus not; a binomial log-likelihood ratio against the corpus period
    rate, scaled by length, internal periods and a penalty for period-less
    occurrences. Everything is one aggregation plus a scalar subquery.
    """
    toks = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(ABBREV_TOKEN), 0)).alias("tok"))
    toks = toks.select(
        F.lower(F.rtrim("tok", F.lit("."))).alias("type"),   # a token ends in one period at most
        F.col("tok").endswith(".").cast("int").alias("with_period"),
    )
    from lisible.session import materialize
    # one narrow table per type, written once: the rate and the candidates both read it
    per_type = materialize(toks.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("with_period").alias("n_period"),
    ), "abbreviation-types")
    # corpus period rate as a scalar subquery, bound to a column once so it is planned once (no join)
    cand = per_type.where("n_period > 0").withColumn("_p0", per_type.select(F.sum("n_period") / F.sum("n")).scalar())
    p0 = F.col("_p0")
    k, n = F.col("n_period"), F.col("n")

    def loglik(p):
        return k * F.log(p) + (n - k) * F.log(F.lit(1.0) - p)

    log_lambda = F.lit(-2.0) * (loglik(p0) - loglik(F.lit(ABBREV_P1)))
    letters = F.length(F.regexp_replace("type", r"[.]", ""))
    f_length = F.exp(-letters.cast("double"))
    f_periods = (F.length("type") - letters + 1).cast("double")
    f_penalty = F.pow(letters.cast("double"), -(n - k).cast("double"))
    score = log_lambda * f_length * f_periods * f_penalty
    return (cand.select("type", "n", "n_period", score.alias("score"))
            .where(F.col("score") >= F.lit(threshold))
            .select("type", F.col("n").cast("bigint").alias("n"),
                    F.col("n_period").cast("bigint").alias("n_period"),
                    F.round("score", 6).alias("score")))


# the word (with internal periods) that stands before the final period of a sentence, if it ends in just one
LAST_WORD = r"(?:^|[^\p{L}.])([\p{L}]+(?:[.][\p{L}]+)*)[.]$"


def sentences_with_learned(docs: DataFrame, learned: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, pos, sentence)`` where a period after a learned abbreviation type ends no sentence.

    Documents are split with the fixed abbreviations first, once; a sentence
    whose last word is a learned type (any number of them: a join on the word,
    hot words salted) is joined with the one after it, with a blank between.
    Only the words before final periods meet the learned types, and come back
    as one short array per key; the sentences are put together inside the row.
    Rows that share a key are one document, their sentences in order of place.
    """
    from lisible.session import materialize

    def placed(s, i):
        # a type has no blank, so only the piece after the last one is searched
        word = F.regexp_extract(F.substring_index(s, " ", -1), LAST_WORD, 1)
        return F.struct(i.alias("pos"), s.alias("sentence"), F.nullif(F.lower(word), F.lit("")).alias("type"))

    split = docs.select(F.col(key), F.transform(sentence_array(F.col(text)), placed).alias("_s"))
    split = materialize(split, "split-sentences").where(F.size("_s") > 0)   # filtered above the stored copy, not split again for it
    if not split.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        split = split.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list("_s"))).alias("_s"))
    ends = F.array_distinct(F.filter(F.col("_s")["type"], lambda t: t.isNotNull()))
    met = split.select(F.col(key), F.explode(ends).alias("type"))
    met = salted_join(met, learned.select("type").distinct(), ["type"], "inner", salt_from=[key])
    open_ = met.groupBy(F.col(key).alias("_key")).agg(F.collect_set("type").alias("_open"))
    told = split.join(open_, split[key].eqNullSafe(open_["_key"]), "left").select(key, "_s", "_open")
    goes_on = lambda i: F.coalesce(F.array_contains("_open", F.get("_s", i - 1)["type"]), F.lit(False))
    starts = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: ~goes_on(i))
    joined = staged(told.where("_open is not null"), _starts=starts)
    sentence = F.transform("_starts", lambda s, k: F.array_join(
        F.slice(F.col("_s")["sentence"], s + 1, F.coalesce(F.get("_starts", k + 1), F.size("_s")) - s), " "))
    out = told.where("_open is null").select(key, F.col("_s")["sentence"].alias("_l")).unionByName(joined.select(key, sentence.alias("_l")))
    return out.select(key, F.posexplode("_l").alias("pos", "sentence"))
