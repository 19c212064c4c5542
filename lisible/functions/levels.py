"""Level arithmetic: softmax scorer stand-in, dominant level, percentages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lisible.constants import (FLOAT_DECIMALS, LEVELS, LIX_CENTRES, LIX_LONG_WORD,
                               LIX_SPREAD, OFFERED_LEVEL, PROMPT_REDUCED_LEVEL,
                               READING_BAND_LIMITS)
from lisible.functions.text import long_word_count, long_words_of, word_count, word_marks, words_of

# dominant level is decided on scores rounded to this many decimals so that
# float summation order cannot flip an exact tie between engines
TIE_DECIMALS = 9


def lix_from_counts(words: Column, long_words: Column) -> Column:
    return words.cast("double") + F.lit(100.0) * long_words / F.greatest(words, F.lit(1))


def lix(sentence: Column) -> Column:
    return lix_from_counts(word_count(sentence), long_word_count(sentence, LIX_LONG_WORD))


def logits(index: Column) -> list[Column]:
    return [-((index - F.lit(c)) * (index - F.lit(c))) / F.lit(LIX_SPREAD) for c in LIX_CENTRES]


def with_level_probabilities(df: DataFrame, sentence: str = "sentence") -> DataFrame:
    """Add A1..C2 in staged projections so each regex runs once per row."""
    tmp = [f"_lg{i}" for i in range(len(LEVELS))]
    df = df.withColumn("_wm", word_marks(F.col(sentence), LIX_LONG_WORD))
    df = df.withColumns({"_w": words_of(F.col("_wm")), "_lw": long_words_of(F.col("_wm"))}).drop("_wm")
    df = df.withColumn("_ix", lix_from_counts(F.col("_w"), F.col("_lw")))
    df = df.withColumns(dict(zip(tmp, logits(F.col("_ix")))))
    df = df.withColumn("_top", F.greatest(*[F.col(t) for t in tmp]))
    df = df.withColumns({f"_e{i}": F.exp(F.col(t) - F.col("_top")) for i, t in enumerate(tmp)})
    total = F.col("_e0")
    for i in range(1, len(LEVELS)):
        total = total + F.col(f"_e{i}")
    df = df.withColumn("_tot", total)
    df = df.withColumns({lv: F.col(f"_e{i}") / F.col("_tot") for i, lv in enumerate(LEVELS)})
    return df.drop("_w", "_lw", "_ix", "_top", "_tot", *tmp, *[f"_e{i}" for i in range(len(LEVELS))])


def probability_arrays(sentences: Column) -> Column:
    """array<string> -> array<array<double>>: six probabilities per sentence.

    Staged higher-order functions: counts (one pattern runs once per
    sentence), index, logits with their maximum, exponentials with their sum,
    quotients; every stage hands its values on in a struct.
    """
    counts = F.transform(F.transform(sentences, lambda s: word_marks(s, LIX_LONG_WORD)), lambda m: F.struct(
        words_of(m).alias("w"), long_words_of(m).alias("l")))
    lg = F.transform(F.transform(counts, lambda c: lix_from_counts(c["w"], c["l"])), lambda x: F.array(*logits(x)))
    ex = F.transform(F.transform(lg, lambda a: F.struct(a.alias("a"), F.array_max(a).alias("top"))),
                     lambda t: F.transform(t["a"], lambda v: F.exp(v - t["top"])))
    sums = F.transform(ex, lambda e: F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda acc, y: acc + y).alias("sum")))
    return F.transform(sums, lambda t: F.transform(t["e"], lambda v: v / t["sum"]))


def dominant_level(cols: list[Column] | None = None) -> Column:
    """First level reaching the maximum (lowest level wins ties)."""
    cols = cols if cols is not None else [F.col(lv) for lv in LEVELS]
    rounded = [F.round(c, TIE_DECIMALS) for c in cols]
    top = F.greatest(*rounded)
    expr = None
    for lv, c in zip(LEVELS, rounded):
        expr = F.when(c == top, F.lit(lv)) if expr is None else expr.when(c == top, F.lit(lv))
    return expr


def round_levels(prefix: str = "") -> list[Column]:
    return [F.round(F.col(prefix + lv), FLOAT_DECIMALS).alias(lv) for lv in LEVELS]


def reading_minutes(text: Column) -> Column:
    return F.floor(F.length(text) / F.lit(1000)).cast("bigint")


def reading_band(minutes: Column) -> Column:
    expr = None
    for i, limit in enumerate(READING_BAND_LIMITS):
        expr = F.when(minutes < limit, F.lit(i)) if expr is None else expr.when(minutes < limit, F.lit(i))
    return expr.otherwise(F.lit(len(READING_BAND_LIMITS))).cast("int")


LEVEL_DIM_SCHEMA = T.StructType([
    T.StructField("level", T.StringType(), False),
    T.StructField("rank", T.IntegerType(), False),
    T.StructField("reduced_level", T.StringType(), False),
    T.StructField("offered_level", T.StringType(), True),
])


def level_dim(spark: SparkSession) -> DataFrame:
    """Dimension table: level, rank, prompt reduction, offered target (fixed, 10 rows)."""
    rows = []
    numbered = [k for k in PROMPT_REDUCED_LEVEL if k not in LEVELS]
    for i, lv in enumerate(LEVELS + numbered):
        rank = i if lv in LEVELS else int(lv.replace("level", "")) - 1
        rows.append((lv, rank, PROMPT_REDUCED_LEVEL[lv], OFFERED_LEVEL.get(lv)))
    return spark.createDataFrame(rows, LEVEL_DIM_SCHEMA)


def level_rank(level: Column) -> Column:
    expr = None
    for i, lv in enumerate(LEVELS):
        expr = F.when(level == lv, F.lit(i)) if expr is None else expr.when(level == lv, F.lit(i))
    return expr
