"""Generation batches keep little on disk: slots' ids alone are stored, tables go when they are spent, shuffles when a job ends."""

import os
import re
import time

import pytest
from pyspark.sql import functions as F

from lisible import session
from lisible.operators import simplify as sp
from lisible.plans import simplify as Q

DOCS = [(i, "Une phrase courte. " + f"Une autre phrase {i}, bien plus longue ; elle a mot{i} et mot{i * 7}. " * (i % 4) + "Fin !", "fr") for i in range(40)]


@pytest.fixture()
def sf_dir(spark, tmp_path):
    spark.createDataFrame(DOCS + [DOCS[3], (5, "Autre texte. Deux.", "fr")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def _bytes(folder):
    return sum(os.path.getsize(f"{d}/{n}") for d, _, names in os.walk(folder) for n in names)


def _plain(encoded, batch_size, pad_to):
    """The same batches by plain code, rows of one key and length in the order of their hashes."""
    rows = sorted((len(r["ids"]), (r["doc_id"] is not None, r["doc_id"] or 0), r["pos"], r["h"], r["doc_id"], r["ids"]) for r in encoded)
    longest = max(r[0] for r in rows)
    out = []
    for at, (n, _, pos, _, doc, ids) in enumerate(rows):
        start = at // batch_size * batch_size
        size = longest if pad_to == "global" else max(r[0] for r in rows[start:start + batch_size])
        out.append((doc, pos, at // batch_size, n, size, longest, [sp.PAD_ID] * (size - n) + ids, [0] * (size - n) + [1] * n))
    return out


@pytest.mark.parametrize("pad_to", ["batch", "global"])
def test_batches_and_their_lengths_equal_plain_code(spark, pad_to):
    # many lengths, many rows of one length over several batches, repeated and missing keys, rows that come twice
    rows = [(None if i % 11 == 0 else i // 2, i % 2, list(range(i % 3 if i % 5 else i % 17))) for i in range(150)]
    enc = spark.createDataFrame(rows + rows[:9], "doc_id long, pos int, ids array<bigint>")
    want = _plain(enc.withColumn("h", F.xxhash64("ids")).collect(), 4, pad_to)
    got = sp.generation_batches(enc, batch_size=4, pad_to=pad_to).collect()
    key = lambda r: (r[2], r[3], str(r[0]), r[1], r[6])
    assert sorted(((*r[:6], r["input_ids"], r["attention_mask"]) for r in got), key=key) \
        == sorted(((d, p, b, n, s, g, i, m) for d, p, b, n, s, g, i, m in want), key=key)
    assert all(r["labels"] == r["input_ids"] and r["max_length"] == max(128, 2 * r["batch_len"]) for r in got)


@pytest.mark.parametrize("share", [0, 40, 500_000])   # every token rare, some, none
def test_slots_give_the_same_batches_as_whole_prompts(spark, sf_dir, monkeypatch, share):
    monkeypatch.setattr(sp, "FREQUENT_SHARE", share)
    levels = Q.levels(spark, sf_dir)
    whole = sp.encode_prompts(sp.simplification_prompts(levels), sp.vocabulary(sp.simplification_prompts(levels)))
    want = sorted(map(str, sp.generation_batches(whole).collect()))
    rows, ids = Q.encoded(spark, sf_dir, late=True)
    assert rows.columns == ["doc_id", "pos", "_ends", "_ids"] and dict(rows.dtypes)["_ids"] == "array<int>"
    assert rows.select(F.max(F.size("_ids"))).first()[0] < whole.select(F.min(F.size("ids"))).first()[0]   # no constants
    assert sorted(map(str, sp.generation_batches(rows, ids=ids).collect())) == want


def test_spent_tables_are_gone(spark, sf_dir):
    base = session.ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(base))
    out = Q.q_generation_batches(spark, sf_dir)
    left = {re.sub("-[0-9a-f]{12}$", "", n) for n in set(os.listdir(base)) - before if _bytes(f"{base}/{n}")}
    assert "prompt-order" in left and not left & {"sentence-levels", "prompt-ids", "prompt-slots", "prompt-rows", "prompt-vocabulary"}
    assert out.count() == out.select("doc_id", "pos", "input_ids", "batch_id").count() > 40


def test_shuffles_go_with_their_job(spark):
    local = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {n for top in local for _, _, names in os.walk(top) for n in names if n.startswith("shuffle_")}
    before = files()
    with session.passing_shuffles(spark):
        session.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test-shuffle")
        session.materialize(spark.range(1000).repartitionByRange(3, "id"), "test-shuffle")
    assert spark.conf.get(session.SHUFFLE_CLEANUP) == "false"
    for _ in range(40):   # the files are removed in the background
        if not files() - before:
            break
        time.sleep(0.25)
    assert not files() - before
