"""Text expressions against plain-Python expectations."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lisible.functions.markdown import relocate_images
from lisible.functions.text import clip, sentence_array, token_count


def _one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("o")).first()["o"]


def test_sentences_keep_abbreviations_and_quotes(spark):
    text = "M. Dupont est là. Il dit « Bonjour ! » puis part… Ensuite ? Oui.\nFin"
    out = _one(spark, text, sentence_array)
    assert out == ["M. Dupont est là.", "Il dit « Bonjour ! »", "puis part…", "Ensuite ?", "Oui.", "Fin"]


def test_sentences_initials_numbers_and_blanks(spark):
    out = _one(spark, "  J. Martin a 3.5 ans. Mme Roy aussi.  ", sentence_array)
    assert out == ["J. Martin a 3.5 ans.", "Mme Roy aussi."]
    assert _one(spark, "", sentence_array) == []
    assert _one(spark, " \n ", sentence_array) == []


def test_smoke_sentences_rank(spark):
    """An easy sentence scores at or below a long hedged one."""
    from lisible.functions.levels import dominant_level, level_rank
    from lisible.operators.scoring import LixScorer
    rows = [("Le chat est sur le tapis.",),
            ("À n'en pas douter, la voiture peut certainement être située dans le garage souterrain !",)]
    df = LixScorer().score(spark.createDataFrame(rows, "sentence string"))
    ranks = [r["r"] for r in df.select(level_rank(dominant_level()).alias("r")).collect()]
    assert ranks[0] <= ranks[1]


def test_token_count(spark):
    assert _one(spark, "Bonjour, le monde !", token_count) == 5 + 2
    assert _one(spark, "", token_count) == 2


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aé😀 .\n", max_size=80), st.integers(min_value=0, max_value=70))
def test_clip_matches_python(spark, text, n):
    expected = text[:n] + ("..." if len(text) > n else "")
    assert _one(spark, text, lambda c: clip(c, n)) == expected


def _relocate_py(text):
    image = r"!\[.*?\]\(.*?\)"
    out = []
    for p in re.split(r"\n{2,}|(?<=\n)#+", text):
        imgs = re.findall(image, p)
        out.append(re.sub(image, "", p) + "\n\n" + "\n\n".join(imgs))
    return "\n\n".join(out)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "\n", "#", "![x](y)", "![a b](c)", "![p\rq](r)", "!", "[", ")", "\r"]),
                max_size=25))
def test_relocate_images_matches_python(spark, parts):
    text = "".join(parts)
    assert _one(spark, text, relocate_images) == _relocate_py(text)


def test_learned_abbreviations_feed_the_splitter(spark):
    from lisible.operators.sentences import learn_abbreviations, sentences_with_learned
    text = " ".join([f"Voir le sect. suivant et le vol. deux de la partie {w}." for w in ("un", "trois", "cinq")] * 10)
    docs = spark.createDataFrame([(1, text), (2, "Nous lisons le ibid. Puis la suite.")], "doc_id long, text string")
    learned = learn_abbreviations(docs)
    assert "sect" in {r["type"] for r in learned.collect()}
    two = spark.createDataFrame([(1, "Voir le Sect. Suivant. La fin. Et sect."), (2, ""), (3, None)], "doc_id long, text string")
    got = [(r["pos"], r["sentence"]) for r in sentences_with_learned(two, learned).orderBy("pos").collect()]
    assert got == [(0, "Voir le Sect. Suivant."), (1, "La fin."), (2, "Et sect.")]


def test_a_learned_type_with_periods_or_signs_is_no_pattern(spark):
    """Learned types are joined as words: ``e.g`` protects only itself, not ``egg`` or ``ebg``."""
    from lisible.operators.sentences import sentences_with_learned
    learned = spark.createDataFrame([("e.g",)], "type string")
    docs = spark.createDataFrame([(1, "Un egg. Deux ebg. Trois e.g. Quatre.")], "doc_id long, text string")
    got = [r["sentence"] for r in sentences_with_learned(docs, learned).orderBy("pos").collect()]
    assert got == ["Un egg.", "Deux ebg.", "Trois e.g. Quatre."]


def test_private_use_characters_come_back(spark):
    """Web icon fonts use these code points; the splitter's own marks must not be confused with them."""
    from lisible.operators.sentences import sentences
    text = "Un \ue000 deux. Le Dr. \ue001 vient\ue002. Fin\ue003 ! \ue000\ue002 reste\ue000\ue003 ici."
    got = [r["sentence"] for r in sentences(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("pos").collect()]
    assert got == ["Un \ue000 deux.", "Le Dr. \ue001 vient\ue002.", "Fin\ue003 !", "\ue000\ue002 reste\ue000\ue003 ici."]
