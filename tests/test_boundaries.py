"""The trained sentence splitter against a plain implementation of the same method."""

import math
import random
from collections import Counter, defaultdict

import pytest
import regex as re

from lisible.operators import boundaries as B

WORD = r"[\p{L}\p{N}]+(?:[.'’\-][\p{L}\p{N}]+)*"
END = re.compile("([.!?…]+[»\"”’)\\]]*(?:[  ]+[»”])*)[ \t\n\r]+")


def pieces(text):
    out, start = [], 0
    for m in END.finditer(text):
        out.append(text[start:m.end(1)])
        start = m.end()
    out.append(text[start:])
    return [p.strip(" \t\n\r") for p in out if p.strip(" \t\n\r")]


def kind(word):
    return "##" if re.fullmatch("[0-9]+", word) else word.lower()


def case(word):
    return "U" if re.match(r"\p{Lu}", word) else "l" if re.match(r"\p{Ll}", word) else "-"


def likelihood(a, b, ab, n):
    term = lambda k, p: k * math.log(p) if k > 0 else 0.0
    fit = lambda k, of, p: term(k, p) + term(of - k, 1 - p)
    rest = max(n - a, 1)
    return -2 * (fit(ab, a, b / n) + fit(b - ab, rest, b / n) - fit(ab, a, ab / a) - fit(b - ab, rest, (b - ab) / rest))


def plain(texts):
    """[(text number, position, boundary, reason)] and the sentences of each text."""
    segs = [pieces(t) for t in texts]
    n, dots, low_in, up_in = Counter(), Counter(), Counter(), Counter()
    places = []
    for d, parts in enumerate(segs):
        for i, seg in enumerate(parts):
            for k, token in enumerate(re.findall(WORD + "[.]?", seg)):
                w = token[:-1] if token.endswith(".") else token
                n[kind(w)] += 1
                dots[kind(w)] += token.endswith(".")
                if k:
                    low_in[kind(w)] += case(w) == "l"
                    up_in[kind(w)] += case(w) == "U"
            if i + 1 < len(parts):
                m = re.search("(" + WORD + ")?([.!?…]+)[»\"”’)\\]  ]*$", seg)
                f = re.match(r"[^\p{L}\p{N}]*(" + WORD + ")", parts[i + 1])
                mark = "period" if m[2] == "." else "mark" if re.search("[!?]", m[2]) else "ellipsis"
                follow = f[1] if f else ""
                places.append((d, i, kind(m[1] or ""), mark, kind(follow), case(follow)))
    words = sum(n.values())
    rate = min(max(sum(dots.values()) / max(words, 1), 1e-9), 1 - 1e-9)
    short = set()
    for t in n:
        if dots[t] and re.search(r"\p{L}", t):
            fit = lambda p: dots[t] * math.log(p) + (n[t] - dots[t]) * math.log(1 - p)
            letters = len(t.replace(".", ""))
            if -2 * (fit(rate) - fit(0.99)) * math.exp(-letters) * (t.count(".") + 1) * float(letters) ** -(n[t] - dots[t]) >= 0.3:
                short.add(t)
    sure = [p[3] == "mark" or p[3] == "period" and p[2] not in short for p in places]
    after, low, up, low_more, up_more, together = (Counter() for _ in range(6))
    for p, s in zip(places, sure):
        after[p[4]] += s
        (low if s else low_more)[p[4]] += p[5] == "l"
        (up if s else up_more)[p[4]] += p[5] == "U"
        together[p[2], p[4]] += p[3] == "period"
    told = []
    for (d, i, last, mark, follow, c), _ in zip(places, sure):
        known = n[follow] > 0
        a, k = after[follow], n[follow]
        starter = known and a > 0 and a * words > k * sum(sure) and bool(re.match(r"\p{L}", follow)) and likelihood(sum(sure), k, a, words) >= 30
        seen_low = known and low_in[follow] + low_more[follow] + low[follow] > 0
        begins = c == "U" and seen_low and up_in[follow] + up_more[follow] == 0
        goes_on = c == "l" and known and (up_in[follow] + up_more[follow] + up[follow] > 0 or low[follow] == 0)
        initial, number = bool(re.fullmatch(r"\p{L}", last)), last == "##"
        ab = together[last, follow]
        if mark == "mark":
            reason = "mark"
        elif mark == "ellipsis":
            reason = "ellipsis_end" if c == "U" else "ellipsis"
        elif (last in short or initial or number) and known and not starter and ab * words > dots[last] * k and likelihood(dots[last], k, ab, words) >= 7.88:
            reason = "collocation"
        elif last in short:
            reason = "abbreviation_end" if begins else "abbreviation_starter" if c == "U" and starter else "abbreviation"
        elif initial and goes_on:
            reason = "initial"
        elif initial and c == "U" and not begins and not seen_low:
            reason = "initial_name"
        elif number and goes_on:
            reason = "ordinal"
        else:
            reason = "period"
        told.append((d, i, reason not in B.NO_BOUNDARY, reason))
    open_ = {(d, i) for d, i, b, _ in told if not b}
    joined = defaultdict(list)
    for d, parts in enumerate(segs):
        for i, seg in enumerate(parts):
            if i and (d, i - 1) in open_:
                joined[d][-1] += " " + seg
            else:
                joined[d].append(seg)
    return told, joined


def corpus(seed=1, n=400):
    r = random.Random(seed)
    names, words = ["Martin", "Dupont", "Roux", "Klee"], ["chat", "table", "rouge", "marche", "vite", "porte", "ouvre", "grand"]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(r.randrange(1, 9)):
            body = " ".join(r.choice(words) for _ in range(r.randrange(2, 7)))
            parts.append(r.choice([
                f"Le {body}.", f"Mais {body} !", f"Le prof. {r.choice(names)} {body}.", f"Il a vu env. {r.choice(words)} et le {body}.", f"Il {body} etc. {r.choice(words).title()} {body}.",
                f"J. {r.choice(names)} {body}.", f"Le 3. {body}…", f"« Le {body}. » Puis {body}?", f"Hier… {body}.",
                f"Le {body} no. {r.randrange(40)}. Le {body}.",
                f"Pour {r.choice(words)} etc. Mais {body}."]))
        out.append(r.choice([" ", "\n"]).join(parts))
    return out + ["", " \n", "...", "?! a", "Fin. 12. 13.", "a. b. C."]


@pytest.fixture(scope="module")
def model(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    places = B.materialize(B.candidates(docs), "test-places")
    return docs, places, B.learn_boundaries(docs, places)


def test_decisions_equal_the_plain_method(model):
    docs, places, m = model
    told, _ = plain(corpus())
    got = sorted((r["doc_id"], r["pos"], r["boundary"], r["reason"]) for r in B.boundaries(places, m).collect())
    assert got == sorted(told)
    assert {"collocation", "abbreviation", "abbreviation_starter", "period", "mark", "ellipsis", "ellipsis_end"} <= {r[3] for r in told}


def test_sentences_equal_the_plain_method(model):
    docs, places, m = model
    _, want = plain(corpus())
    got = defaultdict(list)
    for r in sorted(B.sentences_by(docs, places, m).collect(), key=lambda r: (r["doc_id"], r["pos"])):
        assert r["pos"] == len(got[r["doc_id"]])
        got[r["doc_id"]].append(r["sentence"])
    assert got == {d: s for d, s in want.items() if s}


def test_learned_abbreviations_hold_their_sentences_together(model):
    docs, places, m = model
    short = {r["type"] for r in m.abbreviations.collect()}
    assert {"prof", "env", "no"} <= short and not short & {"chat", "le", "mais", "martin"}
    sentences = [r["sentence"] for r in B.sentences_by(docs, places, m).collect()]
    assert not any(s.endswith(("prof.", "env.")) for s in sentences)


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    places = B.materialize(B.candidates(docs), "test-places")
    m = B.learn_boundaries(docs, places)
    assert B.boundaries(places, m).collect() == [] and B.sentences_by(docs, places, m).collect() == []


def test_null_texts_and_private_marks(spark):
    docs = spark.createDataFrame([(1, None), (2, "A  b. C")], "doc_id bigint, text string")
    places = B.materialize(B.candidates(docs), "test-places")
    got = B.sentences_by(docs, places, B.learn_boundaries(docs, places)).collect()
    assert " ".join(r["sentence"] for r in got) == "A  b. C" and {r["doc_id"] for r in got} == {2}


def test_texts_are_not_shuffled_by_word(model):
    docs, places, m = model
    plan = B.boundaries(places, m)._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan and "segs" not in plan
