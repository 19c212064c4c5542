"""Sentences are split once, blanks and lengths are told without patterns, and only short keys travel."""

from pyspark.sql import functions as F

from lisible.functions import text as X
from lisible.operators import sentences as sn
from lisible.operators.scoring import scored_documents
from lisible.plans import simplify as Q


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_blanks_are_stripped_as_the_pattern_does(spark):
    texts = ["", " ", "\t\n\r ", " a ", "a b", " a  ", " a \u0085", "a  ", "a\n  ", "\u0085 ", " \U0001D400 ", "a\n", "\r\na\r\n", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(1)
    assert df.where(~X.strip_ws(F.col("t")).eqNullSafe(F.regexp_replace("t", X.TRIM, ""))).count() == 0
    assert "trim(" in _plan(df.select(X.strip_ws(F.col("t"))))


def test_only_long_sentences_are_counted(spark):
    texts = ["", "a", "a b", "abc", "abcd", ". . .", "\U0001D400" * 3, "a.b.c", "....", "     "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(1)
    assert df.where(X.within_tokens(F.col("t"), 5) != (X.token_count(F.col("t")) <= 5)).count() == 0
    got = scored_documents(spark.createDataFrame([(1, "a b c d e f. Un mot."), (2, "a.b.c.d.")], "doc_id long, text string"), max_tokens=6)
    assert sorted((r["doc_id"], r["n_sentences"]) for r in got.collect()) == [(1, 1), (2, 0)]


def test_progress_reads_stored_sentences(spark, tmp_path):
    rows = [(i, "Une phrase. Une autre. La fin.", "fr") for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    progress = Q.q_generation_progress(spark, str(tmp_path))
    assert X.SENT_END not in _plan(progress)
    assert all(r["total"] == 3 and r["done"] == 1 for r in progress.collect())


def test_learned_types_meet_words_not_sentences(spark):
    docs = spark.createDataFrame([(1, "Voir art. Ensuite sect. Puis tome. La fin."), (2, "Rien ici. Fin."), (None, "Un sect. Deux."), (None, "Trois. Quatre."),
                                  (3, None), (4, "")], "doc_id long, text string")
    learned = spark.createDataFrame([("sect",), ("tome",), ("sect",)], "type string")
    out = sn.sentences_with_learned(docs, learned)
    plan = _plan(out)
    assert X.SENT_END not in plan and "Window" not in plan
    got = [(r["doc_id"], r["pos"], r["sentence"]) for r in out.orderBy("doc_id", "pos").collect()]
    # rows that share a key are one document, in order of place
    assert got == [(None, 0, "Trois."), (None, 1, "Un sect. Deux."), (None, 2, "Quatre."),
                   (1, 0, "Voir art. Ensuite sect. Puis tome. La fin."), (2, 0, "Rien ici."), (2, 1, "Fin.")]
