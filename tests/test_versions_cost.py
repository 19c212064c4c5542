"""The simplification path does its work once per article, and leaves the text out of joins that do not need it."""

from pyspark.sql import functions as F

from lisible.operators import simplify as sp
from lisible.plans import documents as D
from lisible.plans import simplify as Q


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _documents(spark, path):
    rows = [(i, f"Phrase numéro {i}; la suite. Une autre (avec un mot) ici.", "fr") for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_versions_are_made_and_scored_once_per_article(spark, tmp_path):
    v = Q.versions(spark, _documents(spark, tmp_path))
    assert _plan(v).count("Join ") == 1   # the catalog's own: texts and ids
    got = sorted((r["doc_id"], r["seq"], r["text"]) for r in v.collect())
    assert got == [(i, k, f"Phrase numéro {i} Une autre ici.") for i in range(12) for k in range(1, i % 4 + 1)]


def test_requests_are_stored_and_name_articles_past_the_end(spark, tmp_path):
    r = Q.requests(spark, _documents(spark, tmp_path))
    assert "Join " not in _plan(r)
    assert sorted(x["article_id"] for x in r.where("article_id >= 12").collect()) == [21]


def test_catalog_without_text_joins_without_text(spark, tmp_path):
    narrow = D.doc_catalog(spark, _documents(spark, tmp_path)).select("article_id", "title")
    joined = [line for line in _plan(narrow).splitlines() if "Join " in line]
    assert joined and not any("xxhash64(text" in line for line in joined)


def test_rewrites_are_computed_once(spark):
    df = spark.createDataFrame([(0, "a ; b"), (1, "(x)"), (2, ""), (3, None), (4, "c (d) e : f")], "i int, s string").repartition(1)
    for g, want in ((sp.RuleGenerator(), ["a", "(x)", "", None, "c e"]), (sp.KeepGenerator(), ["a ; b", "(x)", "", None, "c e : f"])):
        made = df.select("i", F.transform(F.array("s"), g.expression)[0].alias("out"))
        assert [r["out"] for r in made.orderBy("i").collect()] == want
        assert _plan(made).count(sp.PARENS) == 1
