"""Benchmark decontamination: size-partitioned MinHash containment search.

The question is asymmetric: does a long document contain most of a short test
item? A min-hash of the item (its shingle with the smallest hash) lies in the
document with the probability of the item's containment, however long the
document is. So items are sketched and documents are probed. Items are
partitioned by size; in partition p (``2**(p-1)`` to ``2**p`` distinct shingles)
an item is sketched by its ``sketch_size(p)`` smallest hashes (all, if it has
fewer). At a containment of ``PERCENT`` an item misses at most
``n - ceil(n * PERCENT / 100)`` shingles, so at least the sketch size less that
many of its sketch must be found: the search loses nothing.

Candidates are verified on full sets: the shared shingles of item and document
are counted exactly. Documents pass through a Bloom filter of the sketch
hashes, whose size is fixed (``BLOOM_BITS``) whatever the number of items;
only hits leave the task that reads the text.

Inputs and their results: an item of fewer words than a shingle is one shingle
of its whole word sequence, and matches documents that consist of just these
words, or hold them as such a short text; items and documents without words
match nothing; null texts are empty; items that repeat an item_id are searched
each by its own text, and matches name each (doc_id, item_id) once, with the
highest containment; a null doc_id or item_id is kept as an id of its own;
columns other than ids and texts are left alone; an empty table on either side
gives no matches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lisible.llm.bloom import bloom_filter, bloom_positions, not_among
from lisible.llm.common import read, stored
from lisible.llm.near_dup import set_keys, shingles_sql
from lisible.llm.wordhash import chunks, distinct, mix, shingles

WIDTH = 5
PERCENT = 80
#: Hashes of an item that must be found beyond those it may miss; more are more selective.
SURPLUS = 3


def missable(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Shingles that an item of n may miss and still be contained."""
    return n - -(-n * percent // 100)


def size_partition(n: np.ndarray) -> np.ndarray:
    """p with 2**(p-1) < n <= 2**p."""
    return np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)


def sketch_size(p: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Smallest hashes that sketch an item of partition p."""
    return missable(np.left_shift(1, p), percent) + SURPLUS


def item_sets(items: DataFrame, percent: int) -> DataFrame:
    """item_id, item (key of the set), n, need, sketch array<long>, shingles array<long>; one row per id and set."""
    def run(batches):
        for batch in batches:
            for start, stop, hashes, words in chunks(batch.column(1)):
                values, counts = distinct(*shingles(hashes, words, WIDTH))
                key, _ = set_keys(values, counts)
                ends = np.cumsum(counts)
                k = np.minimum(counts, sketch_size(size_partition(counts), percent))
                sets = [values[e - c:e] for e, c in zip(ends, counts)]
                rows = np.flatnonzero(counts > 0)
                # the hash order of a sketch is another than the shingles' own
                sketches = [s[np.argsort(mix(s ^ np.uint64(0xB5297A4D3F84D5B5)))[:m]] for s, m in zip(sets, k)]
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, stop - start).take(pa.array(rows)),
                    pa.array(key.view(np.int64)[rows]), pa.array(counts[rows]),
                    pa.array(np.maximum(1, k - missable(counts, percent))[rows]),
                    pa.array([sketches[i].view(np.int64) for i in rows], longs),
                    pa.array([sets[i].view(np.int64) for i in rows], longs)],
                    ["item_id", "item", "n", "need", "sketch", "shingles"])

    longs = "array<bigint>"
    return items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, f"item_id bigint, item bigint, n bigint, need bigint, sketch {longs}, shingles {longs}") \
        .dropDuplicates(["item_id", "item"])


def probe(docs: DataFrame, bloom: np.ndarray) -> DataFrame:
    """doc_id, th (the text's hash), row (key of its set), hits array<long>, shingles array<long> of documents with hits."""
    bits = len(bloom) * 64
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def run(batches):
        words_of = shared.value

        def holds(at):
            return (words_of[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0

        longs = pa.list_(pa.int64())
        for batch in batches:
            rows, texts, keys, hits, sets = [], [], [], [], []
            for start, stop, hashes, words in chunks(batch.column(1)):
                values, counts = shingles(hashes, words, WIDTH)
                low, high = bloom_positions(values, bits)
                at = np.flatnonzero(holds(low))
                at = at[holds(high[at])]
                if not len(at):
                    continue
                stops = np.cumsum(counts)
                owner = np.searchsorted(stops, at, "right")
                for i in np.unique(owner):
                    own = np.unique(values[stops[i] - counts[i]:stops[i]])
                    rows.append(batch.column(0)[start + int(i)].as_py())
                    texts.append(batch.column(2)[start + int(i)].as_py())
                    keys.append(int(set_keys(own, np.array([len(own)]))[0].view(np.int64)[0]))
                    hits.append(np.unique(values[at[owner == i]]).view(np.int64))
                    sets.append(own.view(np.int64))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.int64()), pa.array(texts, pa.int64()), pa.array(keys, pa.int64()), pa.array(hits, longs), pa.array(sets, longs)],
                    ["doc_id", "th", "row", "hits", "shingles"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th")) \
        .mapInArrow(run, "doc_id bigint, th bigint, row bigint, hits array<bigint>, shingles array<bigint>")


def _contained(docs: DataFrame, items: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The probes (see ``probe``) and (doc_id, row, item_id, n, n_shared) of every text that contains an item."""
    sets = stored(item_sets(items, percent), "bench-items")
    sketch = sets.select("item_id", "item", "need", F.explode("sketch").alias("h"))
    found = stored(probe(docs, bloom_filter(sketch.select("h"))), "bench-probes")
    hits = found.select("doc_id", "row", F.explode("hits").alias("h")).distinct()
    per = hits.join(sketch, "h").groupBy("doc_id", "row", "item_id", "item").agg(
        F.count(F.lit(1)).alias("got"), F.first("need").alias("need")).where("got >= need")
    candidates = per.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), F.col("item_id").alias("i"), F.col("item").alias("t"))
    own = found.select("doc_id", "row", "shingles").dropDuplicates(["doc_id", "row"])
    full = candidates.join(own, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("r") == F.col("row")))
    its = sets.select("item_id", "item", "n", F.col("shingles").alias("its"))
    full = full.join(its, F.col("i").eqNullSafe(F.col("item_id")) & (F.col("t") == F.col("item")))
    full = full.withColumn("n_shared", F.size(F.array_intersect("its", "shingles")).cast("bigint"))
    return found, full.where(F.lit(100) * F.col("n_shared") >= F.lit(percent) * F.col("n"))


def matches(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of every document that contains an item."""
    _, full = _contained(docs, items, percent)
    best = full.groupBy("doc_id", "item_id").agg(F.max(F.struct(
        (F.col("n_shared") / F.col("n")).alias("containment"), F.col("n").alias("n_shingles"), "n_shared")).alias("m"))
    return best.select("doc_id", "item_id", "m.n_shingles", "m.n_shared", "m.containment")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))


def drop_contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that contain no test item; columns stay as they are, whatever their names.

    Rows are told by id and text together, so a clean text that shares its id
    (or has none) with a contaminated one stays.
    """
    found, full = _contained(docs, items, percent)
    texts = found.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "th")
    bad = full.select("doc_id", "row").distinct().join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r"))) \
        .select(F.col("d").alias("_bench_id"), F.col("th").alias("_bench_th")).distinct()
    bad = stored(bad.select("*", F.xxhash64("_bench_id", "_bench_th").alias("h")), "bench-bad")
    ident, own = F.col("doc_id").cast("bigint"), F.xxhash64(F.col("text").cast("string"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), ident.alias("_id"), own.alias("_th"), F.xxhash64(ident, own).alias("h"))
    return not_among(rows, bad, F.col("_id").eqNullSafe(F.col("_bench_id")) & (F.col("_th") == F.col("_bench_th")))


ORACLE = "WITH" + shingles_sql("documents", "doc_id", WIDTH) + "," + shingles_sql("benchmark", "item_id", WIDTH, "item_") + """,
p AS (SELECT each.k AS d, item_each.k AS i, count(*) AS n FROM each JOIN item_each ON each.x = item_each.x GROUP BY each.k, item_each.k)
SELECT s.doc_id, t.item_id, CAST(len(t.sh) AS BIGINT) AS n_shingles, CAST(p.n AS BIGINT) AS n_shared,
  CAST(p.n AS DOUBLE) / len(t.sh) AS containment
FROM p JOIN sets s ON s.k = p.d JOIN item_sets t ON t.k = p.i WHERE 100 * p.n >= 80 * len(t.sh)
"""
