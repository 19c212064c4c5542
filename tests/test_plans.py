"""Plan shape checks: pushdown, pruning, no single-partition window on data, broadcasts only where bounded."""

from pyspark.sql import functions as F

from lisible.sources.tables import documents, read_table
from lisible.operators import catalog as cat
from lisible.operators.joins import salted_join

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_language_filter_pushed_and_columns_pruned(spark):
    df = read_table(spark, SF, "documents").where(F.col("lang") == "fr").select("doc_id")
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,fr)]" in plan
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def test_scoring_has_no_shuffle(spark):
    from lisible.operators.scoring import scored_documents
    df = scored_documents(read_table(spark, SF, "documents").select("doc_id", "text"))
    assert "Exchange" not in _plan(df)


def test_dense_ids_do_not_use_global_window_on_data(spark):
    df = spark.range(100).select(F.col("id").alias("k"))
    plan = _plan(cat.assign_dense_ids(df, "k"))
    # the only single-partition step is over per-partition counts (bounded by the partition count)
    assert plan.count("SinglePartition") <= 1
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_salted_join_spreads_a_hot_key(spark):
    big = spark.range(10000).select(F.lit(1).alias("k"), F.col("id"))
    small = spark.createDataFrame([(1, "x")], "k int, v string")
    j = salted_join(big, small, ["k"], salt_from=["id"], buckets=8, rows=100)
    per_salt = (big.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(8))).groupBy("_s").count().collect())
    assert len(per_salt) == 8 and j.count() == 10000


def test_first_per_url_is_limited_before_the_shuffle(spark):
    import __spark_entry__ as E
    plan = _plan(E.queries()["new_urls"](spark, SF))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_template_join_is_salted(spark):
    from lisible.operators.pages import page_main_text
    plan = _plan(page_main_text(read_table(spark, SF, "pages").select("page_id", "url", "html")))
    assert "_salt" in plan   # the join key carries the salt next to the host


def test_no_text_is_replicated_by_a_salt(spark):
    """No generator that replicates rows stands over a relation that holds article texts."""
    import re
    from lisible.operators import simplify as sp
    levels = "A1 double, A2 double, B1 double, B2 double, C1 double, C2 double"
    arts = spark.createDataFrame([(0, "t", "Un chat. Fin.")], "article_id long, title string, text string")
    todo = spark.createDataFrame([(0, 0, "rule-rewrite:v1")], "article_id long, simplification_id long, model string")
    plan = _plan(sp.simplify_and_rescore(todo, arts))
    generators = re.findall(r"Generate explode\(([^\n]*)", plan)
    assert not any("text" in g for g in generators) and "_salt" not in plan and levels
