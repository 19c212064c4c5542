import itertools
import random

import numpy as np
import pytest

from lisible.llm import near_dup as nd
from lisible.llm.components import components


def shingle_set(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))}


def brute(rows, width=4):
    """component of every row, all pairs of sets compared."""
    sets = [shingle_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), len(s), str(least.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def fixture():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 120]))] for _ in range(40)]
    rows, doc = [], 100
    for words in base:
        for _ in range(rng.choice([1, 2, 4, 12])):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 3])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((doc, " ".join(own).upper() if rng.random() < 0.3 else " ".join(own)))
            doc += 1
    rng.shuffle(rows)
    return rows + [(1, None), (2, ""), (3, " \n "), (4, "two words"), (5, "two  words"), (6, "two words"), (7, "words two"),
                   (8, "x " * 30_000), (9, "x x x x"), (None, "two words"), (None, "only here and nowhere else"), (6, "two words")]


@pytest.mark.parametrize("partitions", [1, 5])
def test_equals_brute_force(spark, partitions):
    rows = fixture()
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, cid int").repartition(partitions)
    got = nd.near_duplicates(docs, width=4).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    for n, k in ((2000, 500), (40, 10), (3, 1)):
        a, b = pool[:n], pool[k:n + k]
        s = nd.sketches(np.concatenate([a, b]), np.array([n, n]))
        assert (s != nd._EMPTY).all()
        true = (n - k) / (n + k)
        assert abs((s[0] == s[1]).mean() - true) < 0.15


def test_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"b{i}" for i in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        own = list(base)
        own[rng.randrange(60)] = f"n{i}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in nd.near_duplicates(docs, width=4).collect()} == {0}


def test_drop_keeps_one_of_each_group(spark):
    rows = [(3, "a b c d e f g"), (1, "a b c d e f g"), (2, "q r s t u v"), (9, None)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, kept string")
    out = nd.drop_near_duplicates(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 2, 9]
    assert nd.drop_near_duplicates(docs.limit(0)).count() == 0 and nd.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(1, 60)]
    hub = [(1000, i) for i in range(1001, 1300)]
    links = chain + hub + [(7, 7), (1299, 2000), (5, 4), (5, 4)]
    rng.shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and all(got[i] == 1000 for i in [*range(1000, 1300), 2000])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_strays_of_a_large_bucket(spark, monkeypatch):
    """Copies that lie too far from the pivot, and a chain of them, with buckets cut into several blocks."""
    monkeypatch.setattr(nd, "SMALL", 2)
    monkeypatch.setattr(nd, "STRAY_BLOCK", 3)
    monkeypatch.setattr(nd, "MEMBER_BLOCK", 4)
    rng = random.Random(6)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(i % 5):
            own[rng.randrange(80)] = f"n{i}x{rng.randrange(1000)}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = nd.near_duplicates(docs, width=4).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)


def test_near_copies_without_ids_and_ids_with_two_texts(spark):
    rng = random.Random(8)
    base = [[f"b{k}x{i}" for i in range(60)] for k in range(4)]

    def near(k):
        own = list(base[k])
        own[rng.choice([0, 59])] = f"n{rng.random()}"
        return " ".join(own)

    rows = [(1, " ".join(base[0])), (None, near(0)), (7, near(0)), (None, near(1)), (None, near(1)), (None, near(1)),
            (5, near(2)), (5, " ".join(f"unique{i}" for i in range(50))), (4, near(2)), (9, near(3)), (9, near(3)), (8, near(0)), (8, near(3))]
    rows += [rows[3], rows[3], rows[0]]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, th string").repartition(3)
    got = nd.near_duplicates(docs, width=4).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)
    kept = [(r.doc_id, r.text) for r in nd.drop_near_duplicates(docs, width=4).collect()]
    # one row of each group: the least id, or any row if none has one
    sets = {t: shingle_set(t, 4) for _, t in rows}
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert len(kept) == 5 and not any(alike(a, b) for (_, a), (_, b) in itertools.combinations(kept, 2))
    assert {d for d, _ in kept} == {1, None, 5, 4, 8} and (5, rows[7][1]) in kept


@pytest.mark.parametrize("ids", [[None] * 4, [3] * 4])
def test_rows_repeated_in_full_leave_one(spark, ids):
    docs = spark.createDataFrame([(d, "a b c d e f g", i) for i, d in enumerate(ids)] + [(None, None, 9), (None, "other words", 9)], "doc_id long, text string, n int")
    out = nd.drop_near_duplicates(docs).collect()
    assert sorted(str(r.text) for r in out) == ["None", "a b c d e f g", "other words"]
    assert {(str(r.component_id), r.kept) for r in nd.near_duplicates(docs).collect() if r.n_shingles == 3} == {(str(ids[0]), ids[0] is not None)}


def test_blocks_are_cut_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(nd, "SMALL", 2)
    monkeypatch.setattr(nd, "STRAY_SHINGLES", 150)
    monkeypatch.setattr(nd, "MEMBER_SHINGLES", 400)
    test_strays_of_a_large_bucket(spark, monkeypatch)
