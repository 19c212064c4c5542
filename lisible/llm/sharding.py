"""Shards of nearly equal bytes by Karmarkar-Karp differencing; equal texts stay together.

A group is all documents of one text and cannot be divided. Differencing
starts with one partial partition per group and repeatedly combines the two
with the largest spread, oppositely ordered: the fullest bin of one with the
emptiest of the other. It runs on levels. Every task bundles its groups into
``BUNDLES`` bins of its own. While there are more than ``TOP`` bundles, tasks
difference the bundles of ``FAN`` tasks at a time into ``BUNDLES`` bundles of
bundles. The top level, at most ``TOP`` bundles and the few groups that are
heavier than a bundle should be, is differenced into the shards; its size is
bounded by parameters, whatever the rows and partitions.

Slots count up within a shard without a gap: rows are numbered within
``SLOT_BUCKETS`` hash buckets of a shard, so a shard (or a group that holds a
third of all rows) is numbered by many tasks.

Inputs and their results: a null text has no bytes (size 16), checksum 0 and is
a group of its own, apart from the empty text; ties are broken by the groups'
hashes; repeated rows get a slot each; a null doc_id is sharded like any
other; columns other than doc_id and text are ignored; an empty table gives no
rows. A group larger than the mean shard makes its shard larger than the
others; the rest stay nearly equal.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lisible.llm.common import join_on_hot_key, read, stored

SHARDS = 40
#: Bytes that a document takes besides its text.
OVERHEAD = 16
#: Bins into which a task bundles its groups.
BUNDLES = 64
#: Groups differenced together in a task; the results of such runs are differenced in turn.
RUN = 20_000
#: Bundles that the top level takes, and tasks whose bundles are differenced together below it.
TOP, FAN = 25_600, 200
#: A group with at least 1 / HEAVY of all bytes stands alone in the second level; at most HEAVY groups can.
HEAVY = 4000
SLOT_BUCKETS = 4096


def difference(parts: list[list[tuple[int, object]]], bins: int) -> list[tuple[int, list]]:
    """Karmarkar-Karp differencing of partial partitions into ``bins`` bins.

    A partial partition is a list of (load, content), at most one per bin; the
    result is the bins, fullest first, as (load, contents). Only differences to
    the emptiest bin steer the search; loads are carried along whole.
    """
    heap = []
    for order, part in enumerate(parts):
        part = sorted(([load, [content]] for load, content in part), key=lambda x: -x[0])
        part += [[0, []] for _ in range(bins - len(part))]
        heap.append((part[-1][0] - part[0][0], order, part))
    heapq.heapify(heap)
    order = len(parts)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        merged = [[x[0] + y[0], (x[1], y[1]) if x[1] and y[1] else x[1] or y[1]] for x, y in zip(a, reversed(b))]
        merged.sort(key=lambda x: -x[0])
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], order, merged))
        order += 1
    if not heap:
        return [(0, []) for _ in range(bins)]
    return [(load, _flat(content)) for load, content in heap[0][2]]


def _flat(content) -> list:
    """Contents of a bin; a pair of bins is a tuple, a bin a list."""
    out, stack = [], [content]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack.extend(reversed(x))
        else:
            out.extend(x)
    return out


def bundle(groups: DataFrame) -> DataFrame:
    """(h, crc, size, bytes) of groups to (h, crc, size, bytes, part, bin): every task's own differencing."""
    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        held, runs, start = [], [], 0

        def difference_run(block):
            """Bins of one run as a partial partition of (bytes, rows of the block)."""
            order = np.lexsort((block[:, 0], block[:, 3]))[::-1]
            done = difference([[(int(block[i, 3]), int(i))] for i in order], BUNDLES)
            return [(load, np.array(rows, np.int64)) for load, rows in done]

        def flush(block):
            held.append(block)
            runs.append([(load, (len(held) - 1, rows)) for load, rows in difference_run(block) if len(rows)])

        rest = np.zeros((0, 4), np.int64)
        for batch in batches:
            own = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1).astype(np.int64)
            rest = np.concatenate([rest, own])
            while len(rest) >= RUN:
                flush(rest[:RUN])
                rest = rest[RUN:]
        if len(rest):
            flush(rest)
        if not held:
            return
        bins = [np.zeros(len(b), np.int64) for b in held]
        for number, (_, contents) in enumerate(difference(runs, BUNDLES)):
            for block, rows in contents:
                bins[block][rows] = number
        for block, numbers in zip(held, bins):
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(np.ascontiguousarray(block[:, i])) for i in range(4)),
                 pa.array(np.full(len(block), part, np.int64)), pa.array(numbers)],
                ["h", "crc", "size", "bytes", "part", "bin"])

    return groups.select("h", "crc", "size", "bytes").mapInArrow(
        run, "h bigint, crc bigint, size bigint, bytes bigint, part bigint, bin bigint")


def assign_bytes(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(h, crc, size, n, shard) for a stored table of groups (h, crc, size, n, bytes)."""
    spark = groups.sparkSession
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    bar = max(1, -(-total // HEAVY))
    heavy = groups.where(F.col("bytes") >= bar).select("h", "crc", "size", "bytes")
    light = stored(bundle(groups.where(F.col("bytes") < bar).repartition("h")), "shard-bundles")
    names, loads = merge_bundles(light.groupBy("part", "bin").agg(F.sum("bytes").alias("bytes")))
    items = [((r["part"], r["bin"]), r["bytes"]) for r in loads.collect()]  # at most TOP
    items += [((r["h"], r["crc"], r["size"]), r["bytes"]) for r in heavy.collect()]  # at most HEAVY
    items.sort(key=lambda x: (-x[1], len(x[0]), x[0]))
    done = difference([[(load, name)] for name, load in items], shards)
    bundles = [(*name, s) for s, (_, names_) in enumerate(done) for name in names_ if len(name) == 2]
    alone = [(*name, s) for s, (_, names_) in enumerate(done) for name in names_ if len(name) == 3]
    at = F.broadcast(spark.createDataFrame(bundles, "top_part bigint, top_bin bigint, shard int"))  # at most TOP rows
    lone = spark.createDataFrame(alone, "h bigint, crc bigint, size bigint, shard int")
    told = light.join(names.join(at, ["top_part", "top_bin"]), ["part", "bin"]).select("h", "crc", "size", "shard").unionByName(lone)
    return groups.select("h", "crc", "size", "n").join(told, ["h", "crc", "size"])


def merge_bundles(loads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(part, bin, top_part, top_bin) of all bundles, and the top level's (part, bin, bytes), at most TOP."""
    top = stored(loads, "shard-loads")
    names = top.select("part", "bin", F.col("part").alias("top_part"), F.col("bin").alias("top_bin"))

    def merge(rows):
        rows = rows.sort_values(["bytes", "part", "bin"], ascending=[False, True, True]).reset_index(drop=True)
        bins = np.zeros(len(rows), np.int64)
        for number, (_, contents) in enumerate(difference([[(int(b), i)] for i, b in enumerate(rows["bytes"])], BUNDLES)):
            bins[np.array(contents, np.int64)] = number
        return rows[["part", "bin", "g", "bytes"]].assign(new_bin=bins)

    before, now = None, top.count()
    while now > TOP and now != before:
        parts = -(-now // (FAN * BUNDLES))
        grouped = top.withColumn("g", F.pmod(F.xxhash64("part"), F.lit(parts)))
        merged = stored(grouped.groupBy("g").applyInPandas(merge, "part bigint, bin bigint, g bigint, bytes bigint, new_bin bigint"), "shard-merged")
        step = merged.select(F.col("part").alias("top_part"), F.col("bin").alias("top_bin"), F.col("g").alias("_part"), F.col("new_bin").alias("_bin"))
        names = stored(names.join(step, ["top_part", "top_bin"]).select("part", "bin", F.col("_part").alias("top_part"), F.col("_bin").alias("top_bin")), "shard-names")
        top = stored(merged.groupBy(F.col("g").alias("part"), F.col("new_bin").alias("bin")).agg(F.sum("bytes").alias("bytes")), "shard-loads")
        before, now = now, top.count()
    return names, top


def with_slots(rows: DataFrame) -> DataFrame:
    """Add ``slot``, gapless from 0 within ``shard``; ``rows`` is a stored table (doc_id, shard, ...)."""
    bucketed = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(SLOT_BUCKETS)))
    counts = bucketed.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # shards x SLOT_BUCKETS rows, whatever the number of documents
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = bucketed.withColumn("_i", F.row_number().over(
        Window.partitionBy("shard", "_bucket").orderBy("doc_id", "h")) - 1)
    # both sides stand by (shard, bucket) after the window, so the join moves only the starts
    return numbered.join(starts, ["shard", "_bucket"]) \
        .withColumn("slot", (F.col("_start") + F.col("_i")).cast("bigint")).drop("_bucket", "_start", "_i")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row."""
    text = F.col("text").cast("string")
    rows = stored(docs.select(
        F.col("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("bigint").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("bigint").alias("crc"),
        F.xxhash64(text).alias("h")), "shard-rows")
    groups = stored(rows.groupBy("h", "crc", "size").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")), "shard-groups")
    total = rows.count()
    placed = stored(join_on_hot_key(rows, assign_bytes(groups, shards), ["h", "crc", "size"], "n", total).drop("n"), "shard-placed")
    return with_slots(placed).select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
