"""Sentence boundaries learned from the corpus, without labels (Kiss & Strunk, 2006).

Texts are cut at every mark that could end a sentence (a *candidate*); what
surrounds a candidate decides whether it does. The evidence is counted once:

- *types*: how often a word carries a period, and how often it stands inside a
  segment in upper and in lower case;
- *pairs*: the word before a candidate, its mark, and the word after it with
  its case; there are far fewer different pairs than candidates.

Abbreviations are types that nearly always carry a period (first pass). With
these, the pairs tell which types stand after a sure boundary in which case,
which start sentences more often than chance (starters) and which abbreviation,
initial or number belongs to the word after it (collocations). The second pass
decides every pair. Only pairs that end no sentence go back to the texts, as
positions; the texts themselves are never shuffled by word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lisible.functions.staged import staged
from lisible.functions.text import ESCAPE, ESCAPED, MARK, SENT_END, strip_ws
from lisible.operators.joins import salted_join
from lisible.session import materialize

WORD_TOKEN = "[\\p{L}\\p{N}]+(?:[.'’\\-][\\p{L}\\p{N}]+)*"
#: The last word of a segment and its marks; closing quotes and brackets may follow.
LAST = "(" + WORD_TOKEN + ")?([.!?…]+)[»\"”’)\\] \\x{00A0}]*$"
FIRST = "^[^\\p{L}\\p{N}]*(" + WORD_TOKEN + ")"
NUMBER = "##"

ABBREVIATION_RATE = 0.99       # rate of periods after an abbreviation under the alternative hypothesis
ABBREVIATION_SCORE = 0.3       # scaled log-likelihood of an abbreviation
STARTER_LIKELIHOOD = 30.0      # log-likelihood of a frequent sentence starter
COLLOCATION_LIKELIHOOD = 7.88  # log-likelihood of a pair that holds together (0.5 % level of chi-square)


def candidate_segments(text: Column) -> Column:
    """Array of the pieces between candidates: end marks, closing marks, then blanks; no abbreviation is protected."""
    escaped = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPED))
    parts = F.split(F.regexp_replace(escaped, SENT_END, "$1" + MARK), MARK)
    cleaned = F.transform(parts, lambda s: F.replace(strip_ws(s), F.lit(ESCAPED), F.lit(ESCAPE)))
    return F.filter(cleaned, lambda s: s != "")


def word_type(word: Column) -> Column:
    """Lower-cased; all numbers are one type."""
    return F.when(word.rlike("^[0-9]+$"), F.lit(NUMBER)).otherwise(F.lower(word))


def word_case(word: Column) -> Column:
    return F.when(word.rlike("^\\p{Lu}"), F.lit("U")).when(word.rlike("^\\p{Ll}"), F.lit("l")).otherwise(F.lit("-"))


def segments(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return staged(docs.select(F.col(key), F.col(text).alias("_text")), segs=candidate_segments(F.col("_text"))).drop("_text")


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, pos, last, mark, next, next_case)``: every place between two segments, by the number of the first one.

    ``last`` and ``next`` are types; ``mark`` is ``period`` (one full stop), ``ellipsis`` or ``mark`` (has ! or ?).
    """
    def between(a, b):
        return F.struct(F.regexp_extract(a, LAST, 1).alias("last"), F.regexp_extract(a, LAST, 2).alias("marks"),
                        F.regexp_extract(b, FIRST, 1).alias("word"), b.isNull().alias("end"))

    def told(x):
        return F.struct(word_type(x["last"]).alias("last"),
                        F.when(x["marks"] == ".", F.lit("period")).when(x["marks"].rlike("[!?]"), F.lit("mark")).otherwise(F.lit("ellipsis")).alias("mark"),
                        word_type(x["word"]).alias("next"), word_case(x["word"]).alias("next_case"), x["end"].alias("end"))
    # in two steps: each pattern is searched once, however often the second step reads what it found
    found = F.zip_with("segs", F.slice("segs", F.lit(2), F.size("segs")), between)
    each = segments(docs, key, text).select(key, F.posexplode(F.transform(found, told)).alias("pos", "c"))
    return each.where("not c.end").select(key, "pos", "c.last", "c.mark", "c.next", "c.next_case")


def type_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(type, n, n_period, lower_in, upper_in)``: all words, those with a period, and those inside a segment by case."""
    words = segments(docs, key, text).select(F.explode("segs").alias("seg")) \
        .select(F.posexplode(F.regexp_extract_all("seg", F.lit("(" + WORD_TOKEN + "[.]?)"), 0)).alias("k", "token"))
    word = F.regexp_replace("token", "[.]$", "")
    inside = lambda case: F.sum(((F.col("k") > 0) & (F.col("case") == case)).cast("bigint"))
    return words.select("k", word_type(word).alias("type"), word_case(word).alias("case"), F.col("token").endswith(".").alias("period")) \
        .groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("period").cast("bigint")).alias("n_period"),
                             inside("l").alias("lower_in"), inside("U").alias("upper_in"))


def _log_term(k: Column, p: Column) -> Column:
    return F.when(k > 0, k * F.log(p)).otherwise(F.lit(0.0))


def collocation_likelihood(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Log-likelihood ratio of two events seen ``a`` and ``b`` times among ``n``, ``ab`` times together."""
    def fit(k, of, p):
        return _log_term(k, p) + _log_term(of - k, F.lit(1.0) - p)
    rest = F.greatest(n - a, F.lit(1))
    p, p1, p2 = b / n, ab / a, (b - ab) / rest
    return F.lit(-2.0) * (fit(ab, a, p) + fit(b - ab, rest, p) - fit(ab, a, p1) - fit(b - ab, rest, p2))


def abbreviation_types(types: DataFrame) -> DataFrame:
    """``(type, score)``: types whose periods belong to them, by length-weighted log-likelihood against the corpus rate."""
    rate = types.select(F.least(F.greatest(F.sum("n_period") / F.sum("n"), F.lit(1e-9)), F.lit(1 - 1e-9))).scalar()
    seen = types.where((F.col("n_period") > 0) & F.col("type").rlike("\\p{L}")).withColumn("_rate", rate)
    k, n, p0, p1 = F.col("n_period"), F.col("n"), F.col("_rate"), F.lit(ABBREVIATION_RATE)
    fit = lambda p: k * F.log(p) + (n - k) * F.log(F.lit(1.0) - p)
    inner = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    letters = (F.length("type") - inner).cast("double")
    score = F.lit(-2.0) * (fit(p0) - fit(p1)) * F.exp(-letters) * (inner + 1).cast("double") * F.pow(letters, -(n - k).cast("double"))
    return seen.select("type", score.alias("score")).where(F.col("score") >= ABBREVIATION_SCORE)


@dataclass(frozen=True)
class BoundaryModel:
    """``types``, ``abbreviations``, ``evidence`` (per type after a candidate) and ``decisions`` (per pair), as stored tables."""
    types: DataFrame
    abbreviations: DataFrame
    evidence: DataFrame
    decisions: DataFrame


def learn_boundaries(docs: DataFrame, places: DataFrame, key: str = "doc_id", text: str = "text") -> BoundaryModel:
    """Both passes over the types and pairs of a corpus; ``places`` is its stored table of ``candidates``."""
    types = materialize(type_counts(docs, key, text), "boundary-types")
    pairs = materialize(places.groupBy("last", "mark", "next", "next_case").agg(F.count(F.lit(1)).alias("times")), "boundary-pairs")
    abbreviations = materialize(abbreviation_types(types), "boundary-abbreviations")

    # first pass: which candidates end a sentence by their mark and the type before them
    short = abbreviations.select(F.col("type").alias("last"), F.lit(True).alias("abbreviation"))
    marked = materialize(salted_join(pairs, short, ["last"], "left", salt_from=["next", "next_case", "mark"])
                         .withColumn("abbreviation", F.coalesce("abbreviation", F.lit(False)))
                         .withColumn("sure", (F.col("mark") == "mark") | ((F.col("mark") == "period") & ~F.col("abbreviation"))), "boundary-first")
    times = lambda sure, case: F.sum(F.when((F.col("sure") == sure) & (F.col("next_case") == case), F.col("times")).otherwise(0))
    after = marked.groupBy("next").agg(
        F.sum(F.when(F.col("sure"), F.col("times")).otherwise(0)).alias("after"),
        times(True, "l").alias("lower_first"), times(True, "U").alias("upper_first"),
        times(False, "l").alias("lower_more"), times(False, "U").alias("upper_more"))
    n_words = types.select(F.sum("n")).scalar()
    n_sure = marked.select(F.sum(F.when(F.col("sure"), F.col("times")))).scalar()
    known = after.join(types.withColumnRenamed("type", "next"), "next").withColumn("_words", n_words).withColumn("_sure", n_sure)
    likely = collocation_likelihood(F.col("_sure"), F.col("n"), F.col("after"), F.col("_words")) >= STARTER_LIKELIHOOD
    lower_in, upper_in = F.col("lower_in") + F.col("lower_more"), F.col("upper_in") + F.col("upper_more")
    evidence = materialize(known.select(
        "next", F.col("n").alias("next_n"),
        F.coalesce((F.col("after") > 0) & likely & (F.col("after") * F.col("_words") > F.col("n") * F.col("_sure")) & F.col("next").rlike("^\\p{L}"),
                   F.lit(False)).alias("starter"),
        # upper case here counts if the type is otherwise written small, lower case if it is otherwise written large or begins none
        ((lower_in + F.col("lower_first") > 0) & (upper_in == 0)).alias("upper_tells"),
        ((upper_in + F.col("upper_first") > 0) | (F.col("lower_first") == 0)).alias("lower_tells"),
        (lower_in + F.col("lower_first") > 0).alias("seen_lower")), "boundary-evidence")

    # second pass: one decision per pair
    periods = types.select(F.col("type").alias("last"), F.col("n_period").alias("last_n"))
    by_pair = marked.where("mark = 'period'").groupBy("last", "next").agg(F.sum("times").alias("together"))
    full = salted_join(marked, evidence, ["next"], "left", salt_from=["last", "next_case", "mark"])
    full = salted_join(full, periods, ["last"], "left", salt_from=["next", "next_case", "mark"])
    full = full.join(by_pair, ["last", "next"], "left").withColumn("_words", n_words)
    initial, number = F.col("last").rlike("^\\p{L}$"), F.col("last") == NUMBER
    tied = (collocation_likelihood(F.col("last_n"), F.col("next_n"), F.col("together"), F.col("_words")) >= COLLOCATION_LIKELIHOOD) \
        & (F.col("together") * F.col("_words") > F.col("last_n") * F.col("next_n"))
    collocation = F.coalesce((F.col("abbreviation") | initial | number) & ~F.col("starter") & tied, F.lit(False))
    upper, lower = F.col("next_case") == "U", F.col("next_case") == "l"
    begins = F.coalesce(upper & F.col("upper_tells"), F.lit(False))
    goes_on = F.coalesce(lower & F.col("lower_tells"), F.lit(False))
    period = F.col("mark") == "period"
    reason = (F.when(F.col("mark") == "mark", F.lit("mark"))
              .when(~period, F.when(begins | (upper & ~goes_on), F.lit("ellipsis_end")).otherwise(F.lit("ellipsis")))
              .when(collocation, F.lit("collocation"))
              .when(F.col("abbreviation"), F.when(begins, F.lit("abbreviation_end")).when(upper & F.coalesce("starter", F.lit(False)), F.lit("abbreviation_starter"))
                    .otherwise(F.lit("abbreviation")))
              .when(initial & goes_on, F.lit("initial"))
              .when(initial & upper & ~begins & ~F.coalesce("seen_lower", F.lit(False)), F.lit("initial_name"))
              .when(number & goes_on, F.lit("ordinal"))
              .otherwise(F.lit("period")))
    decided = full.withColumn("reason", reason).select("last", "mark", "next", "next_case", "times", "reason",
                                                       (~F.col("reason").isin(*NO_BOUNDARY)).alias("boundary"))
    return BoundaryModel(types, abbreviations, evidence, materialize(decided, "boundary-decisions"))


#: Reasons for which a candidate ends no sentence.
NO_BOUNDARY = ["ellipsis", "collocation", "abbreviation", "initial", "initial_name", "ordinal"]
PAIR = ["last", "mark", "next", "next_case"]


def boundaries(places: DataFrame, model: BoundaryModel, key: str = "doc_id") -> DataFrame:
    """``(key, pos, last, mark, next, next_case, boundary, reason)`` for every candidate."""
    return salted_join(places, model.decisions.select(*PAIR, "boundary", "reason"), PAIR, "inner", salt_from=[key, "pos"]) \
        .select(key, "pos", *PAIR, "boundary", "reason")


def sentences_by(docs: DataFrame, places: DataFrame, model: BoundaryModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, pos, sentence)`` by the model's decisions; segments that belong together are joined with a blank.

    Only candidates that end no sentence travel, as one short array per document.
    """
    open_pairs = model.decisions.where("not boundary").select(*PAIR)
    open_ = salted_join(places, open_pairs, PAIR, "left_semi", salt_from=[key, "pos"]).groupBy(key).agg(F.collect_set("pos").alias("_open"))
    told = segments(docs, key, text).where(F.size("segs") > 0).join(open_, key, "left")
    numbers = F.sequence(F.lit(0), F.size("segs") - 1)
    none = F.array().cast("array<int>")
    told = staged(told, _starts=F.filter(numbers, lambda i: (i == 0) | ~F.array_contains(F.coalesce("_open", none), i - 1)))
    sentence = F.transform("_starts", lambda s, k: F.array_join(
        F.slice("segs", s + 1, F.coalesce(F.get("_starts", k + 1), F.size("segs")) - s), " "))
    return told.select(key, F.posexplode(sentence).alias("pos", "sentence"))
