import re

from lisible.llm import pii

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = [True, all(int(p) <= 255 for p in m.group().split(".")) if kind == 1 else True,
                  16 <= len(digits) <= 19 and pii.luhn(digits), 8 <= len(digits) <= 15][kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_equals_the_patterns():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=600, deadline=None)
    @given(st.text(alphabet="ab@.-+ 0123456789()é\n", max_size=60))
    def check(text):
        assert pii.base_spans(text) == plain(text)

    check()
    assert pii.base_spans("4111 1111 1111 1111") == [(2, 0, 19)]
    assert pii.base_spans("x" * 200_000) == [] and pii.base_spans("1" * 200_000) == []


def corpus():
    named = [(i, f"Ask Zebulon about it, {'word ' * i}write to zeb@example.com please {i}") for i in range(4)]
    other = [(10 + i, f"please write about it to someone number {i}") for i in range(40)]
    return named + other + [(90, None), (91, ""), (92, "no data here"), (None, "+1 (555) 555-1234")]


def test_terms_that_reveal_an_entity(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_spans(docs).collect()}
    assert len(got) == len(corpus())
    text = corpus()[0][1]
    at = text.index("Zebulon")
    assert f"term:{at}:{at + 7}" in got[0].spans and got[0].n_email == 1
    assert "write" not in {text[t.start:t.stop] for t in got[0].terms}
    assert got[90].spans == got[91].spans == got[92].spans == got[10].spans == ""
    assert got[None].n_phone == 1


def test_sanitise_keeps_rows_and_columns(spark):
    rows = [(a, b, 1, "x") for a, b in corpus()] + [(92, "no data here", 2, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, _pii_x string")
    out = pii.sanitise(docs)
    assert out.columns == docs.columns
    got = sorted((str(r.doc_id), str(r.text)) for r in out.collect())
    assert len(got) == len(rows)
    masked = dict(got)["0"]
    assert "[EMAIL]" in masked and "zeb@example.com" not in masked and "Zebulon" not in masked
    assert ("90", "None") in got and got.count(("92", "no data here")) == 2


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_spans(docs).count() == 0 and pii.sanitise(docs).count() == 0


WORD = r"[A-Za-z0-9\x80-\U0010FFFF]+"


def plain_terms(texts):
    """[(start, stop, action)] of every text by plain counting: all places of revealing terms in texts that hold the entity."""
    import math
    lower = lambda w: "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
    texts, n = [t or "" for t in texts], len(texts)
    df_term, df_entity, df_both, spans_of, entities_of = {}, {}, {}, [], []
    for t in texts:
        spans = pii.base_spans(t)
        own = {f"{pii.KINDS[k]}:{pii._value(k, t[a:b])}" for k, a, b in spans}
        spans_of.append(spans)
        entities_of.append(own)
        places = [(m.start(), m.end()) for m in re.finditer(WORD, t)]
        for w in {lower(t[s:x]) for s, x in places}:
            df_term[w] = df_term.get(w, 0) + 1
        near = set()
        line = lambda at: t.count("\n", 0, at)
        for k, a, b in spans:
            e = f"{pii.KINDS[k]}:{pii._value(k, t[a:b])}"
            before = [p for p in places if p[1] <= a][-pii.NEAR:]
            after = [p for p in places if p[0] >= b][:pii.NEAR]
            for s, x in before + after:
                if x - s >= 2 and abs(line(s) - line(a)) <= 1 and not any(p < x and s < q for _, p, q in spans):
                    near.add((e, lower(t[s:x])))
        for e in own:
            df_entity[e] = df_entity.get(e, 0) + 1
        for pair in near:
            df_both[pair] = df_both.get(pair, 0) + 1
    told = {}
    for (e, w), both in df_both.items():
        rate = df_entity[e] / n
        d = math.log((both + rate) / ((df_term[w] + 1) * rate)) / math.log(1 / rate) if rate < 1 else 0.0
        assert rate == 1 or abs(d - pii.disclosure(float(n), df_entity[e], df_term[w], both)) < 1e-12
        if d >= pii.GENERALISE_AT:
            told.setdefault(w, {})[e] = d
    out = []
    for t, spans, own in zip(texts, spans_of, entities_of):
        found = []
        for m in re.finditer(WORD, t):
            d = max((d for e, d in told.get(lower(m.group()), {}).items() if e in own), default=None)
            if d is not None and m.end() - m.start() >= 2 and not any(p < m.end() and m.start() < q for _, p, q in spans):
                found.append((m.start(), m.end(), "remove" if d >= pii.REMOVE_AT else "generalise"))
        out.append(tuple(found))
    return out


def test_spans_equal_brute_force(spark, monkeypatch):
    import random
    # lower bars, as a small corpus tells less
    monkeypatch.setattr(pii, "GENERALISE_AT", 0.45)
    monkeypatch.setattr(pii, "REMOVE_AT", 0.55)
    r = random.Random(4)
    common, rare = [f"w{i}" for i in range(30)], [f"R{i}x" for i in range(60)]
    rows = []
    for i in range(150):
        lines = [" ".join(r.choice(common if r.random() < 0.9 else rare) for _ in range(r.randrange(1, 14))) for _ in range(r.randrange(1, 6))]
        if i % 3 == 0:
            k = r.randrange(len(lines))
            lines[k] += f" u{r.randrange(25)}@ex.org " + r.choice(["", "+49 30 1234567", "R5x é"])
        rows.append((r.choice([i, i, None, 7]), "\n".join(lines)))
    rows += [rows[0], rows[3], (500, None), (501, ""), (502, "a@b.co"), (None, "R1x R1x c@d.org\n\nR2x")]
    want = plain_terms([t for _, t in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(str(x.doc_id), x.spans, tuple((t.start, t.stop, t.action) for t in x.terms)) for x in pii.find_spans(docs).collect()]
    base = lambda t: [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in pii.base_spans(t or "")]
    assert sorted(got) == sorted((str(d), ",".join(base(t) + [f"term:{a}:{b}" for a, b, _ in own]), own) for (d, t), own in zip(rows, want))
    assert {a for o in want for _, _, a in o} == {"generalise", "remove"} and sum(map(len, want)) > 20


def test_single_texts_neighbouring_lines_and_all_places(spark):
    rows = [(1, "Zebulon Quimby\nzeb@example.com\nregards\n\nlater Zebulon came"), (2, "zeb is another word")] + \
        [(10 + i, f"regards to all of you later, number {i}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_spans(docs).collect()}
    text = rows[0][1]
    assert [text[t.start:t.stop] for t in got[1].terms] == ["Zebulon", "Quimby", "Zebulon"]
    out = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert out[1] == "[NAME] [NAME]\n[EMAIL]\nregards\n\nlater [NAME] came" and all(out[d] == t for d, t in rows[1:])


def test_clashing_columns_of_the_stage(spark):
    docs = spark.createDataFrame([(1, "a@b.co x", "p"), (2, "plain", "q")], "doc_id long, text string, row string") \
        .selectExpr("*", "1 as _pii_doc", "2 as _pii_hash", "3 as _pii_terms", "4 as id", "5 as own", "6 as d", "7 as h", "8 as t", "9 as `a.b`")
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and {r.text for r in out.collect()} == {"[EMAIL] x", "plain"}
