"""Level arithmetic: probabilities, dominant level, percentages, reading bands."""

from pyspark.sql import functions as F

from lisible.constants import LEVELS
from lisible.functions.levels import dominant_level, level_dim, reading_band, reading_minutes
from lisible.operators.catalog import level_percentages
from lisible.operators.scoring import LixScorer


def test_probabilities_sum_to_one(spark):
    rows = [("Le chat dort.",), ("!!!",), ("Anticonstitutionnellement, incontestablement, extraordinairement.",)]
    df = LixScorer().score(spark.createDataFrame(rows, "sentence string"))
    for r in df.collect():
        assert abs(sum(r[lv] for lv in LEVELS) - 1.0) < 1e-12


def test_dominant_level_first_maximum_wins(spark):
    df = spark.createDataFrame([(0.3, 0.3, 0.1, 0.1, 0.1, 0.1), (0.0, 0.1, 0.1, 0.2, 0.3, 0.3)], ",".join(f"{l} double" for l in LEVELS))
    assert [r["lv"] for r in df.select(dominant_level().alias("lv")).collect()] == ["A1", "C1"]


def test_percentages_round_half_even(spark):
    row = (0, 0.025, 0.035, 0.5, 0.145, 0.2, 0.095)
    df = spark.createDataFrame([row], "article_id long, " + ",".join(f"{l} double" for l in LEVELS))
    got = {r["level"]: r["pct"] for r in level_percentages(df).collect()}
    assert got == {lv: float(round(v * 100, 0)) for lv, v in zip(LEVELS, row[1:])}


def test_reading_minutes_and_band(spark):
    lengths = [0, 999, 1000, 2999, 4000, 6500, 9999, 10000, 25000]
    df = spark.createDataFrame([("x" * n,) for n in lengths], "t string")
    out = df.select(reading_minutes(F.col("t")).alias("m")).select("m", reading_band(F.col("m")).alias("b")).collect()
    expected_band = [0 if m < 1 else 1 if m < 3 else 2 if m < 5 else 3 if m < 7 else 4 if m < 10 else 5
                     for m in (n // 1000 for n in lengths)]
    assert [r["m"] for r in out] == [n // 1000 for n in lengths]
    assert [r["b"] for r in out] == expected_band


def test_level_dim(spark):
    rows = {r["level"]: r for r in level_dim(spark).collect()}
    assert rows["C2"]["reduced_level"] == "C1" and rows["C2"]["offered_level"] == "B1"
    assert rows["B2"]["reduced_level"] == "B1" and rows["B2"]["offered_level"] == "A2"
    assert rows["level3"]["reduced_level"] == "level2" and rows["level3"]["offered_level"] is None


def test_learned_scorer_ranks_easy_below_hard(spark):
    from lisible.functions.levels import level_rank
    from lisible.operators.scoring import LearnedScorer, fit_level_model
    easy = ["Le chat dort.", "Il pleut.", "Je mange une pomme.", "Elle lit.", "Nous jouons dehors."]
    hard = ["Nonobstant l'incontestable complexité institutionnelle, les négociations interminables persistent.",
            "L'administration gouvernementale reconsidère systématiquement les recommandations parlementaires.",
            "Indubitablement, l'historiographie contemporaine réinterprète l'épistémologie traditionnelle."]
    rows = [(s, "A1") for s in easy] + [(s, "C2") for s in hard]
    model = fit_level_model(spark.createDataFrame(rows, "sentence string, level string"))
    test = spark.createDataFrame([("Le chien court.",), ("Incontestablement, la réglementation internationale évolue.",)],
                                 "sentence string")
    scored = LearnedScorer(model).score(test)
    from lisible.functions.levels import dominant_level
    ranks = [r["r"] for r in scored.select(level_rank(dominant_level()).alias("r")).collect()]
    assert ranks[0] < ranks[1]
    for r in scored.collect():
        assert abs(sum(r[lv] for lv in LEVELS) - 1.0) < 1e-9


def test_model_scorer_path_matches_native_means(spark):
    """A scorer without in-row expressions goes through the sentence table; same means as the native path."""
    from lisible.operators.scoring import LixScorer, Scorer, scored_documents

    class TableOnly(Scorer):          # same numbers as the native scorer, but no in-row form
        def score(self, df, sentence="sentence"):
            return LixScorer().score(df, sentence)

    docs = spark.createDataFrame([(1, "Le chat dort. Il pleut beaucoup aujourd'hui."), (2, ""), (3, "Oui.")],
                                 "doc_id long, text string")
    native = {r["doc_id"]: r for r in scored_documents(docs).collect()}
    table = {r["doc_id"]: r for r in scored_documents(docs, scorer=TableOnly()).collect()}
    assert native.keys() == table.keys()
    for k in native:
        assert native[k]["n_sentences"] == table[k]["n_sentences"]
        for lv in LEVELS:
            a, b = native[k][lv], table[k][lv]
            assert (a is None and b is None) or abs(a - b) < 1e-12
