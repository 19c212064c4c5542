"""The patterns around a candidate are searched once per candidate."""

from lisible.operators import boundaries as B


def test_patterns_are_searched_once(spark):
    docs = spark.createDataFrame([(1, "M. Dupont part. 12 h. Il reste… là ! Fin"), (2, None)], "doc_id long, text string").repartition(1)
    at = B.candidates(docs)
    assert at._jdf.queryExecution().optimizedPlan().toString().count(B.FIRST) == 1
    got = [(r["last"], r["mark"], r["next"], r["next_case"]) for r in at.orderBy("pos").collect()]
    assert got == [("m", "period", "dupont", "U"), ("part", "period", "##", "-"), ("h", "period", "il", "U"),
                   ("reste", "ellipsis", "là", "l"), ("", "mark", "fin", "U")]
