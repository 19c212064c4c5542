from pyspark.sql import functions as F

from lisible.llm import language_id as li

DOCS = "doc_id long, text string, lang string, score string"
WORDS = {"aa": "lo mira dela casa verde", "bb": "the house on that green hill"}


def rows(n=120):
    out = []
    for i in range(n):
        lang = "aa" if i % 3 else "bb"
        words = WORDS[lang].split()
        out.append((i, " ".join(words[(i * 7 + j * j) % len(words)] for j in range(20 + i % 9)).capitalize(), lang, "x"))
    return out


def predict(spark, data):
    docs = spark.createDataFrame(data, DOCS)
    told = li.identify(docs, li.learn(li.labelled(docs)), F.col("text"), [F.col("doc_id")])
    return {r.doc_id: r for r in told.collect()}


def test_held_out_accuracy(spark):
    spark_docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = li.op2_language_id(spark, "/root/testdata/sf0.01").join(spark_docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = got.count(), got.where("lang = lang_pred").count()
    assert right >= 0.98 * n and got.where("rejected").count() <= 0.01 * n


def test_cases(spark):
    data = rows() + [(500, None, "aa", None), (501, "", "aa", ""), (502, "12 %% !", "bb", ""), (503, "mira casa verde " * 5000, None, ""),
                     (504, "the green house", "  ", "")]
    got = predict(spark, data)
    assert len(got) == len(data)
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and got[500].score == 0.0 and got[500].rejected
    assert got[503].lang_pred == "aa" and got[504].lang_pred == "bb"
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows())


def test_learning_ignores_held_out_rows(spark):
    import zlib
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2][:20]
    data = [r for r in rows() if r[0] not in held] + [(i, "zz qq xx", "cc", "") for i in held]
    assert {r.lang_pred for r in predict(spark, data).values()} <= {"aa", "bb"}


def test_empty_and_unlabelled(spark):
    empty = spark.createDataFrame([], DOCS)
    assert li.filter_language(empty).count() == 0 and li.filter_language(empty).columns == empty.columns
    assert predict(spark, [(1, "words here", None, "")])[1].lang_pred == "und"


def test_filter_keeps_columns_and_repeats(spark):
    data = rows() + [rows()[5]] * 2 + [(900, "??", "aa", "")]
    docs = spark.createDataFrame(data, DOCS)
    out = li.filter_language(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(r[0] for r in data if r[0] != 900)


def test_a_language_of_copies_gets_its_dictionary(spark):
    texts = [f"zuq{'q' * i} xiv wok yil vuz {'kyz ' * (i % 5)}pax" for i in range(60)]
    made = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("draw", F.pmod(F.xxhash64("text", F.lit(2)), F.lit(1 << 40)))
    late = [r.text for r in made.orderBy(F.desc("draw")).limit(4).collect()]  # drawn last
    data = rows() + [(1000 + i, late[i % 4], "cc", "x") for i in range(6000)]
    docs = spark.createDataFrame(data, DOCS)
    groups = li.learn(li.labelled(docs))
    learned = dict(groups[0])
    assert all(li.letters(t) in learned["cc"] for t in late)
    assert all(r.lang_pred == "cc" for r in li.identify(docs.where("lang = 'cc'"), groups, F.col("text"), [F.col("doc_id")]).distinct().collect())


def test_many_languages_go_in_groups(spark, monkeypatch):
    data = rows() + [(300 + i, f"zuq xiv wok {'yil ' * (i % 7)}vuz kyz", "cc", "x") for i in range(60)] + [(500, None, "aa", ""), (501, "12 %", "", "")]
    data += [(600, "lo mira", None, "")]
    whole = predict(spark, data)
    docs = spark.createDataFrame(data, DOCS)
    kept = sorted(r.doc_id for r in li.filter_language(docs).collect())
    monkeypatch.setattr(li, "GROUP", 1)
    assert len(li.learn(li.labelled(docs))) == 3
    parts = predict(spark, data)
    assert {k: tuple(v) for k, v in parts.items()} == {k: tuple(v) for k, v in whole.items()}
    out = li.filter_language(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == kept


def test_better_keeps_the_two_smallest():
    assert li.better((None, 0, 0), ("a", 5, 0)) == ("a", 5, 0) and li.better(("a", 5, 0), (None, 0, 0)) == ("a", 5, 0)
    assert li.better(("a", 5, 7), ("b", 5, 6)) == ("a", 5, 5) and li.better(("a", 5, 0), ("b", 4, 9)) == ("b", 4, 5)
    assert li.better(("a", 5, 6), ("b", 8, 9)) == ("a", 5, 6) and li.better(("a", 5, 0), ("b", 8, 9)) == ("a", 5, 8)


def test_only_letters_count():
    assert li.letters("² ½ ³ ٣ ⅷ _ 12") == b"" and li.letters("a² b½c É") == "a b c é".encode()
    assert li.Encoders([("aa", b"some text of a language")]).predict("² ½ ³")[0] == "und"
