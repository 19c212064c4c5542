"""Sentence work done once per row, with the results of the plain patterns."""

from pyspark.sql import functions as F

from lisible.functions import text as X
from lisible.operators import sentences as sn

TEXTS = ["", " ", "a", "M.M. Mme. x. 12 é.é!? Abcdefg Abcdef abcdefghij", "M. X. etc. vol.p. Mmes.x", "A.B.C.D. E.F.p. p.p.p.p. M.p .p. 3.p. p..p. ",
         "éd. M. \U0001D400. M.\U0001D400. p.\nM.", "1$1 \\ " + "\U0001D400" * 8]


def test_tokens_are_counted_once(spark):
    docs = spark.createDataFrame([(1, "Une phrase. Une autre, plus longue.")], "doc_id long, text string").repartition(1)
    short = sn.short_sentences(sn.sentences(docs), max_tokens=5)
    assert [r["n_tokens"] for r in short.collect()] == [5]
    assert short._jdf.queryExecution().optimizedPlan().toString().count(X.TOKEN) == 1


def test_periods_are_found_from_the_period(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").repartition(1)
    pattern, replacement = X._protect_quickly()
    assert pattern.startswith("[.]")
    plain = F.regexp_replace("t", X.protect_pattern(), "$1$2" + X.PROTECT)
    assert df.where(~plain.eqNullSafe(F.regexp_replace("t", pattern, replacement))).count() == 0
    assert X._protect_quickly(["p.ex"])[0] == X.protect_pattern(["p.ex"])


def test_one_pass_counts_words_and_long_words(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([None, *TEXTS])], "i int, t string").repartition(1)
    m = X.word_marks(F.col("t"), 7)
    wrong = df.where(~X.words_of(m).eqNullSafe(X.word_count(F.col("t"))) | ~X.long_words_of(m).eqNullSafe(X.long_word_count(F.col("t"), 7)))
    assert wrong.count() == 0
