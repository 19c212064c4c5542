import random

import numpy as np

from lisible.llm import decontaminate as dc


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def brute(docs, items):
    out = {}
    for d, t in docs:
        own = shingle_set(t)
        for i, x in items:
            its = shingle_set(x)
            if its and 100 * len(its & own) >= 80 * len(its):
                best = out.get((d, i), (0.0,))
                out[d, i] = max(best, (len(its & own) / len(its), len(its), len(its & own)))
    return out


def fixture():
    rng = random.Random(4)
    v = [f"t{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(v) for _ in range(rng.choice([5, 8, 20, 60])))) for i in range(30)]
    docs = []
    for d in range(120):
        words = [rng.choice(v) for _ in range(rng.choice([3, 50, 2000]))]
        for _ in range(rng.choice([0, 1, 2])):
            part = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                part[rng.randrange(len(part))] = rng.choice(v)
            cut = rng.choice([len(part), len(part), len(part) // 2])
            at = rng.randrange(len(words) + 1)
            words[at:at] = part[:cut]
        docs.append((d, " ".join(words).title()))
    items += [(90, None), (91, " "), (92, "only three words"), (None, items[0][1]), (5, items[6][1]), (5, items[5][1])]
    docs += [(900, None), (901, ""), (902, "Only three  WORDS"), (903, "only three words more"), (None, items[0][1]), docs[3], (3, items[2][1]),
             (904, "z " * 40_000 + items[7][1])]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): (r.containment, r.n_shingles, r.n_shared) for r in dc.matches(d, i).collect()}
    assert got == brute(docs, items)
    assert dc.drop_contaminated(d, i).columns == d.columns
    # each row goes by its own text, whatever shares its id
    left = sorted((str(r.doc_id), str(r.text)) for r in dc.drop_contaminated(d, i).collect())
    assert left == sorted((str(a), str(t)) for a, t in docs if not brute([(a, t)], items))


def test_small_bloom_filter_loses_nothing(spark):
    docs, items = fixture()
    i = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    sketch = dc.item_sets(i, 80).selectExpr("explode(sketch) as h")
    hits = {(r.doc_id, h) for r in dc.probe(d, dc.bloom_filter(sketch, 256)).collect() for h in r.hits}
    more = {(r.doc_id, h) for r in dc.probe(d, dc.bloom_filter(sketch)).collect() for h in r.hits}
    assert more <= hits


def test_pigeonhole():
    for n in range(1, 300):
        k = min(n, int(dc.sketch_size(dc.size_partition(np.array([n])))[0]))
        assert k >= 1 and k - int(dc.missable(np.array([n]))[0]) <= k
        assert 2 ** int(dc.size_partition(np.array([n]))[0]) >= n


def test_empty_sides(spark):
    docs, items = fixture()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert dc.matches(d.limit(0), i).count() == 0 and dc.matches(d, i.limit(0)).count() == 0
    assert dc.drop_contaminated(d, i.limit(0)).count() == len(docs)


def test_clean_texts_that_share_an_id_stay(spark):
    item = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, f"so {item} it goes", "a"), (1, "a clean text of some six words", "b"), (None, item, "c"),
                                  (None, "another clean text without any id at all", "d"), (None, None, "e"), (2, item, "f"), (2, item, "g")],
                                 "doc_id long, text string, th string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = dc.drop_contaminated(docs, items)
    assert out.columns == docs.columns and sorted(r.th for r in out.collect()) == ["b", "d", "e"]
