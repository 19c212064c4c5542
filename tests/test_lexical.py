"""Lexical substitution against plain code on a corpus whose words are interchangeable in pairs."""

import math
import random
from collections import Counter

import pytest
import regex as re

from lisible.operators import lexical as L

PAIRS = [("immense", "grand"), ("rapidement", "vite"), ("habitation", "maison"), ("interroger", "voir")]


def corpus(seed=1, n=500):
    r = random.Random(seed)
    frames = ["le {0} chat dort ici", "un {0} arbre tombe la", "il marche {1} vers la ville", "elle parle {1} avec lui", "la {2} est rouge",
              "une {2} au bord du lac", "il veut {3} son ami", "nous allons {3} la mer"]
    out = []
    for _ in range(n):
        words = [hard if r.random() < 0.3 else easy for hard, easy in PAIRS]
        out.append(". ".join(r.choice(frames).format(*words).capitalize() for _ in range(3)) + ".")
    return out


def plain(texts):
    """{hard word: (substitute, similarity)} by comparing all words with all words."""
    word = re.compile(r"\p{L}+")
    n = Counter(w for t in texts for w in word.findall(t.lower()))
    contexts = {w for w, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:L.CONTEXTS]}
    seen = Counter()
    for t in texts:
        for s in re.split(r"(?<=[.])\s+", t):
            w = word.findall(s.lower())
            for i, a in enumerate(w):
                for j in range(max(0, i - L.WINDOW), min(len(w), i + L.WINDOW + 1)):
                    if j != i and w[j] in contexts and n[a] >= L.MIN_COUNT:
                        seen[a, w[j]] += 1
    total, by_word, by_context = sum(seen.values()), Counter(), Counter()
    for (a, c), k in seen.items():
        by_word[a] += k
        by_context[c] += k
    rows = {}
    for (a, c), k in seen.items():
        v = math.log(k * total / (by_word[a] * by_context[c]))
        if v > 0:
            rows.setdefault(a, {})[c] = v
    norm = {a: math.sqrt(sum(v * v for v in r.values())) for a, r in rows.items()}
    best = {}
    for a in rows:
        if len(a) < L.HARD_LETTERS:
            continue
        for b in rows:
            if len(b) < L.HARD_LETTERS and n[b] > n[a]:
                cos = round(sum(v * rows[b].get(c, 0) for c, v in rows[a].items()) / (norm[a] * norm[b]), 6)
                if cos >= L.MIN_SIMILARITY:
                    best[a] = max(best.get(a, (0, 0, "")), (cos, n[b], b))
    return {a: (b, cos) for a, (cos, _, b) in best.items()}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string").repartition(3)


def test_equals_all_pairs_when_every_word_is_a_neighbour(docs):
    got = {r["word"]: (r["substitute"], r["similarity"]) for r in L.word_substitutes(docs, neighbours=60).collect()}
    want = plain(corpus())
    assert got.keys() == want.keys() and all(got[w][0] == want[w][0] and abs(got[w][1] - want[w][1]) < 2e-6 for w in want)
    assert {w: s for w, (s, _) in got.items()}.items() >= dict(PAIRS[:3]).items()


def test_few_neighbours_find_the_same_words(docs):
    all_ = {r["word"]: r["similarity"] for r in L.word_substitutes(docs, neighbours=60).collect()}
    few = {r["word"]: r["similarity"] for r in L.word_substitutes(docs, neighbours=8).collect()}
    assert few.keys() <= all_.keys() and len(few) >= 0.7 * len(all_) and all(few[w] <= all_[w] for w in few)


def test_neighbours_are_linear_in_the_vocabulary(spark):
    signed = spark.createDataFrame([(f"w{i}", 1.0, [0] * L.BANDS) for i in range(300)], "word string, norm double, bands array<int>")
    assert L.candidate_pairs(signed, 5).count() <= 2 * 5 * 300 * L.BANDS  # all words in one bucket


def test_generator_replaces_hard_words_in_place(spark):
    subs = spark.createDataFrame([("immense", "grand"), ("habitation", "maison")], "word string, substitute string")
    rows = [(1, 0, "Immense ! L'habitation, immense…  fin"), (1, 1, "rien"), (2, 0, ""), (3, 0, "habitation habitation")]
    prompts = spark.createDataFrame(rows, "doc_id long, pos int, sentence string")
    got = {(r["doc_id"], r["pos"]): (r["prediction"], r["status"]) for r in L.LexicalGenerator(subs).generate(prompts).collect()}
    assert got == {(1, 0): ("Grand ! L'maison, grand…  fin", "ok"), (1, 1): ("rien", "ok"), (2, 0): ("", "ok"), (3, 0): ("maison maison", "ok")}


def test_empty_corpus(spark):
    assert L.word_substitutes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
