"""Near-duplicate documents: fast similarity sketches, banding, verification on full sets.

A document's set holds the distinct shingles of its words (A-Z lower-cased).
The sketch has ``SIZE`` coordinates: in round i every shingle is thrown into a
random bin with the value (i, hash); rounds ``SIZE`` and later give every
shingle the bin of their number, so every coordinate is filled after at most
``2 * SIZE`` rounds, however small the set, while large sets fill it in a few.
Two sketches agree at a coordinate with the probability of the sets' Jaccard
similarity, with concentration as strong as for independent min-hashes.
``ROWS`` coordinates make a band; equal bands put documents into one bucket
(at similarity 0.8 a pair misses all ``BANDS`` with probability 5e-6).

Equal sets are one class before anything is compared. In a bucket of at most
``SMALL`` classes, all of its pairs are verified. In larger ones every class is
verified against one pivot, the class that sits in the largest buckets
altogether (the text that the others are copies of), which is linear in the
bucket. Members that this leaves unlinked are compared with all of their
bucket, block by block inside tasks, which give out links only. So every pair
that shares a bucket is either verified or known to be linked through others.
Links are confirmed on the full sets: texts travel to their pivot, a pivot's
members are salted over tasks, and a task holds one pivot's set at a time.

Inputs and their results: a text with fewer words than a shingle has its whole
sequence as one; null texts, empty texts and texts without words have the empty
set and are linked with nothing (their component is their own doc_id); texts
are taken whole; rows that repeat a doc_id, and rows without one, are linked
each by its own text; a null doc_id never names a component and is never kept
(a component without any id is null); columns other than doc_id and text are
left alone; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lisible.llm.bloom import may_hold, not_among
from lisible.llm.common import join_on_hot_key, read, stored
from lisible.llm.components import components
from lisible.llm.wordhash import chunks, distinct, mix, shingles

BANDS, ROWS = 40, 6
SIZE = BANDS * ROWS
#: Similarity in percent from which documents are linked.
PERCENT = 80
#: Buckets of at most this many classes verify all their pairs.
SMALL = 32
#: Members of one pivot that one task verifies in a row.
MEMBERS = 500
#: Strays and members of a large bucket that are compared in one piece, the shingles of either side (on average; a
#: larger set is held alone), and shared shingles taken at a time there.
STRAY_BLOCK, MEMBER_BLOCK, COLUMNS = 128, 512, 4096
STRAY_SHINGLES, MEMBER_SHINGLES = 60_000, 240_000
#: Texts sketched together, in bytes; rounds of the sketch run over all of them at once.
SKETCH_BYTES = 500_000

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64((1 << 40) - 1)


def sketches(values: np.ndarray, counts: np.ndarray, size: int = SIZE) -> np.ndarray:
    """One sketch (row of ``size`` 64-bit values) per set; sets stand one after the other, distinct values each."""
    out = np.full((len(counts), size), _EMPTY)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(len(counts)), counts)
    left = np.flatnonzero(counts > 0)
    for i in range(2 * size):
        if not len(left):
            break
        h = mix(values + np.uint64((i * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        value = (h & _LOW) | np.uint64(i << 40)
        if i < size:
            bins = (((h >> np.uint64(40)) * np.uint64(size)) >> np.uint64(24)).astype(np.int64)
            np.minimum.at(flat, owner * size + bins, value)
        else:
            np.minimum.at(flat, owner * size + (i - size), value)
        open_ = (out[left] == _EMPTY).any(axis=1)
        if not open_.all():
            left = left[open_]
            go_on = np.zeros(len(counts), dtype=bool)
            go_on[left] = True
            keep = go_on[owner]
            values, owner = values[keep], owner[keep]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    parts = sketch.reshape(len(sketch), -1, ROWS)
    h = np.zeros(parts.shape[:2], np.uint64) + np.arange(parts.shape[1], dtype=np.uint64)
    for k in range(ROWS):
        h = mix(h + parts[:, :, k])
    return h


def set_keys(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell a set, as two longs: sums over its members under two mixings."""
    owner = np.repeat(np.arange(len(counts)), counts)
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        h = mix(values ^ np.uint64(salt))
        total = np.zeros(len(counts), np.uint64)
        np.add.at(total, owner, h)
        out.append(mix(total + counts.astype(np.uint64)))
    return out[0], out[1]


def _long(values: np.ndarray, where: np.ndarray | None = None) -> pa.Array:
    return pa.array(values.view(np.int64), mask=None if where is None else where)


def document_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, th (the text's hash), n_shingles, the set's key (c1, c2) and its band keys; an empty set has null keys and no bands."""
    def run(batches):
        for batch in batches:
            for start, stop, hashes, words in chunks(batch.column(1), SKETCH_BYTES):
                values, counts = distinct(*shingles(hashes, words, width))
                c1, c2 = set_keys(values, counts)
                none = counts == 0
                keys = band_keys(sketches(values, counts))[~none]
                offsets = np.concatenate([[0], np.cumsum(np.where(none, 0, BANDS))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), batch.column(2).slice(start, stop - start), pa.array(counts), _long(c1, none), _long(c2, none),
                     pa.ListArray.from_arrays(pa.array(offsets), _long(np.ascontiguousarray(keys).reshape(-1)))],
                    ["doc_id", "th", "n_shingles", "c1", "c2", "bands"])

    return docs.select(_id(), _text(), F.xxhash64(_text()).alias("th")) \
        .mapInArrow(run, "doc_id bigint, th bigint, n_shingles bigint, c1 bigint, c2 bigint, bands array<bigint>")


def _id():
    return F.col("doc_id").cast("bigint").alias("doc_id")


def _text():
    return F.col("text").cast("string").alias("text")


def class_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, c1, c2, text), one row per class of ``wanted`` (cid, c1, c2, least, th): the text of its row with the least id."""
    th = F.xxhash64(_text())
    hit = may_hold(wanted.select(F.xxhash64("least", "th").alias("h")))
    rows = docs.select(_id().alias("_id"), _text(), th.alias("_th")).where(hit(F.xxhash64(F.col("doc_id").cast("bigint"), th)))
    # rows without an id are told by their text alone; copies of a text meet as one row before they are joined
    named = rows.where("_id is not null").join(wanted.hint("merge"), (F.col("_id") == F.col("least")) & (F.col("_th") == F.col("th")))
    nameless = rows.where("_id is null").groupBy("_th").agg(F.min("text").alias("text")) \
        .join(wanted.where("least is null"), F.col("_th") == F.col("th"))
    columns = ["cid", "c1", "c2", "text"]
    texts = stored(named.select(*columns).unionByName(nameless.select(*columns)), "near-texts")
    if texts.count() > wanted.count():  # whole rows are repeated
        texts = stored(texts.dropDuplicates(["cid"]), "near-texts")
    return texts


def verify(texts: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) of the pairs (cid, pivot, size) whose full sets are similar enough.

    ``texts`` holds (cid, c1, c2, text) of the classes. ``size`` bounds how many members a pivot has through one bucket; members
    are salted by it, and the pivot's text goes along to each salt in use.
    """
    salt = F.pmod(F.xxhash64("cid"), F.ceil(F.col("size") / F.lit(MEMBERS)).cast("bigint"))
    members = pairs.select("cid", F.col("pivot"), salt.alias("salt"), F.lit(1).alias("role"))
    pivots = members.select(F.col("pivot").alias("cid"), "pivot", "salt", F.lit(0).alias("role")).distinct()
    rows = texts.join(members.unionByName(pivots), "cid").select("pivot", "salt", "role", "cid", "c1", "c2", "text") \
        .repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "role")

    def run(batches):
        at, pivot_set = None, None
        for batch in batches:
            pivot, role, cid, c1, c2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3, 4, 5))
            a, b = [], []
            for start, stop, hashes, words in chunks(batch.column(6)):
                values, counts = distinct(*shingles(hashes, words, width))
                k1, k2 = (k.view(np.int64) for k in set_keys(values, counts))
                ends = np.cumsum(counts)
                for i in range(start, stop):
                    j = i - start
                    if k1[j] != c1[i] or k2[j] != c2[i]:
                        continue  # another text under the same doc_id
                    own = values[ends[j] - counts[j]:ends[j]]
                    if role[i] == 0:
                        at, pivot_set = pivot[i], own.copy()
                        continue
                    if at != pivot[i]:
                        continue
                    n, m = len(own), len(pivot_set)
                    if 100 * min(n, m) < percent * max(n, m):
                        continue
                    where = np.searchsorted(pivot_set, own)
                    both = int((pivot_set[np.minimum(where, m - 1)] == own).sum())
                    if 100 * both >= percent * (n + m - both):
                        a.append(cid[i])
                        b.append(pivot[i])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def verify_blocks(texts: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) for the strays of every bucket against all its members, on full sets; at most one link per stray and component.

    ``members`` holds (sig, cid, own, stray, n_shingles), own the component so
    far. Strays and members are dealt into blocks by their number and by their
    shingles; every pair of blocks is one piece of work, whose size is bounded,
    so a large bucket is many pieces.
    """
    of_strays = lambda c: F.sum(F.when(F.col("stray"), c).otherwise(0))
    blocks = lambda n, most, held, bytes_: F.greatest(F.ceil(F.col(n) / F.lit(most)), F.ceil(F.col(held) / F.lit(bytes_))).cast("bigint")
    count = members.groupBy("sig").agg(
        of_strays(F.lit(1)).alias("strays"), F.count(F.lit(1)).alias("size"),
        of_strays(F.col("n_shingles")).alias("stray_sum"), F.sum("n_shingles").alias("member_sum")).where("strays > 0")
    dealt = members.join(count, "sig").select(
        "sig", "cid", "own", "stray", blocks("strays", STRAY_BLOCK, "stray_sum", STRAY_SHINGLES).alias("n_s"),
        blocks("size", MEMBER_BLOCK, "member_sum", MEMBER_SHINGLES).alias("n_m"))
    number = lambda n, seed: F.pmod(F.xxhash64("cid", F.lit(seed)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    strays = dealt.where("stray").select("sig", "cid", "own", number("n_s", 1).alias("s"), every("n_m").alias("m"), F.lit(0).alias("role"))
    others = dealt.select("sig", "cid", "own", every("n_s").alias("s"), number("n_m", 2).alias("m"), F.lit(1).alias("role"))
    rows = texts.join(strays.unionByName(others), "cid").select("sig", "s", "m", "role", "cid", "own", "c1", "c2", "text") \
        .repartition("sig", "s", "m").sortWithinPartitions("sig", "s", "m", "role")

    def compare(block):
        """Links of one piece of work: (role, cid, own, set) of its rows."""
        left, right = [r for r in block if r[0] == 0], [r for r in block if r[0] == 1]
        if not left or not right:
            return []
        sizes = [np.array([len(r[3]) for r in side]) for side in (left, right)]
        rows_of = [np.repeat(np.arange(len(side)), n) for side, n in zip((left, right), sizes)]
        values = [np.concatenate([r[3] for r in side]) for side in (left, right)]
        shared = np.intersect1d(np.unique(values[0]), np.unique(values[1]))
        at = [np.searchsorted(shared, v) for v in values]
        hit = [(a < len(shared)) & (shared[np.minimum(a, len(shared) - 1)] == v) if len(shared) else np.zeros(len(v), bool) for a, v in zip(at, values)]
        both = np.zeros((len(left), len(right)), np.float32)
        for start in range(0, len(shared), COLUMNS):  # shared shingles, some at a time
            held = []
            for side in (0, 1):
                keep = hit[side] & (at[side] >= start) & (at[side] < start + COLUMNS)
                part = np.zeros((len(sizes[side]), min(COLUMNS, len(shared) - start)), np.float32)
                part[rows_of[side][keep], at[side][keep] - start] = 1
                held.append(part)
            both += held[0] @ held[1].T
        both = both.astype(np.int64)
        near = 100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)
        told = {}
        for i, j in zip(*np.nonzero(near)):
            if left[i][2] != right[j][2]:
                told.setdefault((left[i][1], right[j][2]), right[j][1])
        return [(cid, other) for (cid, _), other in told.items()]

    def run(batches):
        block, at = [], None
        links = []
        for batch in batches:
            key = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            role, cid, own, c1, c2 = (batch.column(i).to_pylist() for i in range(3, 8))
            for start, stop, hashes, words in chunks(batch.column(8)):
                values, counts = distinct(*shingles(hashes, words, width))
                k1, k2 = (k.view(np.int64) for k in set_keys(values, counts))
                ends = np.cumsum(counts)
                for i in range(start, stop):
                    j = i - start
                    if k1[j] != c1[i] or k2[j] != c2[i]:
                        continue  # another text under the same doc_id
                    if key[i] != at:
                        links += compare(block)
                        block, at = [], key[i]
                    block.append((role[i], cid[i], own[i], values[ends[j] - counts[j]:ends[j]].copy()))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])
                links = []
        links += compare(block)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def link_classes(docs: DataFrame, classes: DataFrame, width: int = 4, percent: int = PERCENT) -> DataFrame:
    """(node, component) of the classes that have a link; ``classes`` is a stored table (cid, c1, c2, least, th, n_shingles, bands)."""
    entries = classes.select(F.explode("bands").alias("sig"), "cid")
    buckets = entries.groupBy("sig").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = stored(entries.join(buckets, "sig"), "near-shared")
    weight = shared.groupBy("cid").agg(F.sum("size").alias("weight"))
    open_ = shared.select("sig", "cid").join(weight, "cid")
    # texts of the classes that share a bucket leave the documents once, for all rounds
    wanted = stored(classes.select("cid", "c1", "c2", "least", "th").join(shared.select("cid").distinct(), "cid", "left_semi"), "near-wanted")
    texts = class_texts(docs, wanted)
    found = open_.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("weight", (-F.col("cid")).alias("least"))).alias("p"))
    open_ = stored(open_.join(found.select("sig", "size", (-F.col("p.least")).alias("pivot")), "sig"), "near-open")
    small, large = open_.where(F.col("size") <= SMALL), open_.where(F.col("size") > SMALL)
    every = small.select("sig", "cid", "size").join(small.select("sig", F.col("cid").alias("pivot")), "sig").where("cid > pivot")
    pairs = every.select("cid", "pivot", "size").unionByName(large.where("cid <> pivot").select("cid", "pivot", "size")) \
        .groupBy("cid", "pivot").agg(F.max("size").alias("size"))
    links = stored(verify(texts, stored(pairs, "near-pairs"), width, percent), "near-links")
    nodes = stored(components(links), "near-nodes")
    # what a large bucket's pivot does not link, directly or through others, meets all of the bucket
    own = nodes.select(F.col("node").alias("cid"), F.col("component").alias("own"))
    its = nodes.select(F.col("node").alias("pivot"), F.col("component").alias("its"))
    large = large.join(own, "cid", "left").join(its, "pivot", "left").select(
        "sig", "cid", F.coalesce("own", "cid").alias("own"), (F.coalesce("own", "cid") != F.coalesce("its", "pivot")).alias("stray"))
    large = large.join(classes.select("cid", "n_shingles"), "cid")
    more = verify_blocks(texts, stored(large, "near-large"), width, percent)
    return components(more.unionByName(nodes.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def _groups(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, th, n_shingles and ``first``, the (no_id, id, th) of its component's first row; null for rows without a set."""
    sets = stored(document_sets(docs, width), "near-sets")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "th")
    classes = sets.where("c1 is not null").groupBy("c1", "c2").agg(
        F.min(row).alias("first"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("copies"))
    # numbered where they are written, so that two classes never share a number, whatever their ids
    classes = stored(classes.select("c1", "c2", "first", "bands", "n_shingles", "copies", F.col("first.id").alias("least"), F.col("first.th").alias("th"),
                                    F.monotonically_increasing_id().alias("cid")), "near-classes")
    nodes = stored(link_classes(docs, classes, width, percent), "near-components")
    linked = nodes.withColumnRenamed("node", "cid").join(classes.select("cid", "first"), "cid")
    first = linked.groupBy("component").agg(F.min("first").alias("its"), F.count(F.lit(1)).alias("n"))
    linked = join_on_hot_key(linked.select("cid", "component"), first, ["component"], "n", nodes.count()).select("cid", "its")
    named = classes.join(linked, "cid", "left").select("c1", "c2", "copies", F.coalesce("its", "first").alias("first"))
    rows = sets.select("doc_id", "th", "n_shingles", "c1", "c2")
    told = join_on_hot_key(rows.where("c1 is not null"), named, ["c1", "c2"], "copies", sets.count()).drop("copies")
    return told.unionByName(rows.where("c1 is null"), allowMissingColumns=True).select("doc_id", "th", "n_shingles", "first")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    component = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.id"))
    return _groups(docs, width, percent).select("doc_id", "n_shingles", component.alias("component_id"),
                                                F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), width=4)


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id (then text hash); five-word shingles.

    Rows are told by id and text together, so an id with two texts, or rows
    without an id, lose only what is a copy. Of rows that are repeated with the
    same id and text one stays. Columns stay as they are, whatever their names.
    """
    told = _groups(docs, width, percent).where("first is not null")
    stays = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))
    marks = told.select("doc_id", "th", stays.alias("stays")).groupBy("doc_id", "th").agg(
        F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n")).where("not stays or n > 1")
    marks = stored(marks.select(F.col("doc_id").alias("_m_id"), F.col("th").alias("_m_th"), "stays", "n"), "near-marks")
    marks = marks.withColumn("h", F.xxhash64("_m_id", "_m_th"))
    ident, th = F.col("doc_id").cast("bigint"), F.xxhash64(_text())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), ident.alias("_id"), th.alias("_th"), F.xxhash64(ident, th).alias("h"))
    on = F.col("_id").eqNullSafe(F.col("_m_id")) & (F.col("_th") == F.col("_m_th"))
    once = not_among(rows, marks, on)
    repeated = marks.where("stays").drop("h")
    if repeated.isEmpty():
        return once
    # rows that are repeated in full: copies meet as one row inside the tasks first
    again = rows.drop("h").join(repeated, on, "left_semi").groupBy("_id", "_th").agg(F.first("row").alias("row"))
    return once.unionByName(again.select("row.*"))


def shingles_sql(table: str, name: str, width: int, prefix: str = "") -> str:
    """CTEs ``{prefix}docs`` (k, id, text), ``{prefix}sets`` (k, id, sh) and ``{prefix}each`` (k, x) of a table's shingles."""
    return rf"""
{prefix}docs AS (SELECT row_number() OVER () AS k, {name}, text FROM {table}),
{prefix}words AS (
  SELECT k, {name}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM {prefix}docs),
{prefix}sets AS (
  SELECT k, {name}, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {width} THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - {width} + 2), lambda i: array_to_string(words[i:i + {width} - 1], ' '))) END AS sh
  FROM {prefix}words),
{prefix}each AS (SELECT k, unnest(sh) AS x FROM {prefix}sets)"""


ORACLE = "WITH RECURSIVE" + shingles_sql("documents", "doc_id", 4) + """,
p AS (SELECT a.k AS a, b.k AS b, count(*) AS n FROM each a JOIN each b ON a.x = b.x AND a.k < b.k GROUP BY a.k, b.k),
l AS (
  SELECT p.a, p.b FROM p JOIN sets sa ON sa.k = p.a JOIN sets sb ON sb.k = p.b
  WHERE 100 * p.n >= 80 * (len(sa.sh) + len(sb.sh) - p.n)),
both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(k, m) AS (SELECT k, k FROM sets UNION SELECT reach.k, both_ways.b FROM reach JOIN both_ways ON reach.m = both_ways.a)
SELECT s.doc_id, CAST(any_value(len(s.sh)) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id, s.doc_id = min(o.doc_id) AS kept
FROM sets s JOIN reach ON reach.k = s.k JOIN docs o ON o.k = reach.m GROUP BY s.k, s.doc_id
"""
