import random
import zlib

from lisible.llm import sharding as sh


def check(rows, got, shards):
    assert len(got) == len(rows)
    slots, of_text, loads = {}, {}, [0] * shards
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(t)
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        loads[r.shard] += r.size
        if len(texts[r.doc_id]) == 1:
            t = texts[r.doc_id][0]
            assert r.size == len((t or "").encode()) + 16 and r.text_crc32 == zlib.crc32((t or "").encode())
            assert of_text.setdefault(t, r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return loads


def test_shards(spark):
    rng = random.Random(1)
    rows = [(i, "é" * rng.randrange(400) + str(rng.randrange(700))) for i in range(3000)]
    rows += [(4000, None), (4001, None), (4002, ""), (None, "x"), (5, rows[5][1]), (5, rows[5][1])]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, shard int")
    loads = check(rows, sh.shard_documents(docs, 8).collect(), 8)
    assert max(loads) - min(loads) <= 0.01 * sum(loads) / 8


def test_hot_group_leaves_the_rest_equal(spark):
    rows = [(i, "hot " * 50) for i in range(1000)] + [(1000 + i, f"text {i} " * (1 + i % 17)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    loads = sorted(check(rows, sh.shard_documents(docs, 10).collect(), 10))
    hot = 1000 * (200 + 16)
    assert loads[-1] == hot and loads[-2] - loads[0] <= 0.02 * loads[0]


def test_differencing():
    rng = random.Random(3)
    for bins in (1, 2, 5):
        sizes = [rng.randrange(1, 1000) for _ in range(200)]
        done = sh.difference([[(s, i)] for i, s in enumerate(sizes)], bins)
        assert sorted(i for _, c in done for i in c) == list(range(200))
        assert all(load == sum(sizes[i] for i in c) for load, c in done)
        assert max(x for x, _ in done) - min(x for x, _ in done) <= 20
    # the textbook example: differencing 8 7 6 5 4 two ways leaves 2
    done = sh.difference([[(s, i)] for i, s in enumerate([8, 7, 6, 5, 4])], 2)
    assert done[0][0] - done[1][0] == 2
    assert sh.difference([], 3) == [(0, [])] * 3


def test_empty(spark):
    assert sh.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_levels_of_bundles(spark, monkeypatch):
    """Twenty tasks' bundles merged four tasks at a time until few are left: nothing is lost, the shards stay equal."""
    monkeypatch.setattr(sh, "TOP", 200)
    monkeypatch.setattr(sh, "FAN", 4)
    rng = random.Random(5)
    loads = [(p, b, rng.randrange(1, 1000)) for p in range(20) for b in range(sh.BUNDLES)]
    names, top = sh.merge_bundles(spark.createDataFrame(loads, "part long, bin long, bytes long"))
    tops = {(r.part, r.bin): r.bytes for r in top.collect()}
    told = {(r.part, r.bin): (r.top_part, r.top_bin) for r in names.collect()}
    assert len(tops) <= 200 and set(told) == {(p, b) for p, b, _ in loads}
    sums = {}
    for p, b, n in loads:
        sums[told[p, b]] = sums.get(told[p, b], 0) + n
    assert sums == tops
    rows = [(i, "é" * rng.randrange(400) + str(i)) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = check(rows, sh.shard_documents(docs, 8).collect(), 8)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(got) - min(got) <= 0.01 * sum(got) / 8
