"""Periodic runs against a direct search over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lisible.llm import periodic_runs as P


def plain(words):
    """All runs: for every period the maximal stretches, those with a smaller period left out."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            stretch = words[i:j + q]
            if length >= max(24, 3 * q) and not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def numbers(words):
    seen = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def documents(seed, n):
    """Texts with runs of many periods: nested ones, broken ones, runs of runs, few and many different words."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        size = r.choice([2, 3, 50, 5000])
        words = []
        while len(words) < r.choice([30, 300, 1500]):
            kind = r.random()
            if kind < 0.4:
                words += [r.randrange(size) for _ in range(r.randrange(1, 80))]
            else:
                block = [r.randrange(size) for _ in range(r.choice([1, 2, 5, 20, 63, 64, 65, 66, 127, 128, 129, 130, 200, 257]))]
                if r.random() < 0.3:  # a block that holds a run itself
                    block += [7] * r.randrange(1, 60)
                if r.random() < 0.3:
                    block = block * r.randrange(1, 4) + [r.randrange(size)]
                words += (block * r.randrange(2, 6))[:len(block) * r.randrange(2, 6) - r.randrange(len(block))]
        out.append(words)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_equals_direct_search(seed):
    docs = documents(seed, 12)
    found = P.find_runs([numbers(w) for w in docs])
    assert found == [plain(w) for w in docs]
    assert any(q > 64 for runs in found for _, _, q in runs)


@pytest.mark.parametrize("q", [1, 2, 63, 64, 65, 66, 96, 127, 128, 129, 192, 255, 256, 257, 400, 513])
def test_planted_period_alone(q):
    r = random.Random(q)
    block = [r.randrange(10 ** 6) for _ in range(q)]
    for length in (max(24, 3 * q) - 1, max(24, 3 * q), 3 * q + 30, 5 * q + 25):
        words = [-5, -6] + (block * 60)[:length] + [-7]
        want = [(2, length, q)] if length >= max(24, 3 * q) else []
        assert P.find_runs([numbers(words)])[0] == want


def test_fibonacci_like_and_constant_words():
    a, b = [0], [0, 1]
    while len(b) < 2500:
        a, b = b, b + a
    assert P.find_runs([numbers(b)])[0] == plain(b)
    assert P.find_runs([numbers([4] * 9000)])[0] == [(0, 9000, 1)]
    assert P.find_runs([numbers(([1] * 40 + [2]) * 200)])[0] == plain(([1] * 40 + [2]) * 200)


def test_words_of_other_documents_do_not_count():
    block = list(range(100))
    assert P.find_runs([numbers(block), numbers(block), numbers(block), numbers(block)]) == [[]] * 4


def test_query_with_awkward_rows(spark, tmp_path):
    planted = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    other = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 3)
    text = " ".join(f"w{i}" for i in range(200))
    spaced = "\t".join(["Aa", "aa", "é x"] * 30) + "\n"
    rows = [(planted, text), (planted, text), (other, spaced), (other, None), (None, " \n"), (None, text), (planted, ""), (other, "ab " * 20000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("start", "collapsed", "n_runs")})
    df.write.parquet(str(tmp_path / "documents.parquet"))
    told = [tuple(r) for r in P.op12_periodic_runs(spark, str(tmp_path)).collect()]

    def expected(doc_id, text):
        words = (text or "").encode().split()
        n = len(words)
        if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
            g = zlib.crc32(str(doc_id).encode()) // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain(words) if n < 5000 else [(0, n, 1)]
        gone = {i for s, k, q in runs for i in range(s + q, s + k)}
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        digest = lambda x: hashlib.sha256(x).hexdigest()
        return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                digest("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()),
                digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))

    assert sorted(told, key=repr) == sorted((expected(*r) for r in rows), key=repr)
    assert P.op12_periodic_runs(spark, str(tmp_path)).columns == [c.split()[0] for c in P.OUT.split(", ")][:-1]


def test_collapsed_text_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b " * 15 + "end")], "doc_id int, text string")
    assert P.periodic_runs(docs, with_text=True).first()["collapsed"] == "a b end"
    assert P.periodic_runs(docs.where("doc_id > 5")).collect() == []


def test_small_tables_equal_direct_search(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in P.op12_periodic_runs(spark, sf).collect():
        words = P.plant((texts[r["doc_id"]] or "").encode().split(), r["doc_id"])
        if len(words) < 1500:
            listed = "".join(f"{a},{b},{c}\n" for a, b, c in plain(words))
            assert r["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
