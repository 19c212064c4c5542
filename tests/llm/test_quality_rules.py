import random
import re

from lisible.llm import quality_rules as qr


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    covered = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(8)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def texts():
    rng = random.Random(3)
    words = ["a", "bb", "é", "the", "x#", "|"]
    out = [None, "", " \n\x0b", "one", "\n\n", "a\x1fb c", "Ünder 12", "x " * 30_000]
    for _ in range(120):
        one = [rng.choice(words) for _ in range(rng.choice([3, 12, 25, 60]))]
        if rng.random() < 0.5:
            one += one[: rng.randrange(len(one))]
        out.append("".join(w + rng.choice([" ", " ", "\n", "  "]) for w in one))
    return out


def test_measures_equal_plain_code(spark):
    data = texts()
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(data)] + [(3, data[3], 5), (None, "a b", 5)], "doc_id long, text string, n_words int")
    got = qr.quality(docs).collect()
    assert len(got) == len(data) + 2
    for r in got:
        t = data[r.doc_id] if r.doc_id is not None else "a b"
        n, chars, symbols, dup, rep = plain(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), t
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n)
        assert r.kept <= (not r.base_failed)


def test_order_changes_the_work_and_not_the_verdict(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    plan = qr.plan_cascade(docs)
    gains = [share / cost for _, cost, share in plan]
    assert gains == sorted(gains, reverse=True) and len(plan) == len(qr.default_rules())
    measured = qr.text_measures(docs)
    verdicts = []
    for rules in (qr.default_rules(), qr.default_rules()[::-1], [r for r, _, _ in plan]):
        verdicts.append({r.doc_id: r.rejected_by is None for r in qr.apply_cascade(measured, rules).collect()})
    assert verdicts[0] == verdicts[1] == verdicts[2] and not all(verdicts[0].values())


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert qr.quality(docs).count() == 0 and len(qr.plan_cascade(docs)) == len(qr.default_rules())
