"""Vector codes: every part of a vector becomes the index of its nearest codebook entry, found by LAESA pivots.

Components become integers ``floor(1024 * x)`` and a vector is cut into
``PARTS`` equal parts. A part position's codebook starts as that part of the
``ENTRIES`` smallest kept ids and is refined for ``ROUNDS`` rounds (assign every
part, replace every entry by the floored mean of its parts).

The nearest entry is searched with a few pivots per part position, fixed once:
initial entries that lie far from each other. The distances of all parts to
them are computed once and stored beside the parts. In every round the entries'
distances to the pivots are computed anew, and by the triangle inequality
``|d(part, pivot) - d(entry, pivot)|`` is at most ``d(part, entry)``. The
entries with the smallest bounds are evaluated first, in exact integers; an
entry whose bound exceeds the best distance found is not evaluated. The rest is
evaluated in the order of the bounds where it is little. Where the bounds leave
more than one in ``DENSE`` (parts spread evenly in many dimensions lie about as
far from every pivot), a block's rest is evaluated as one matrix product, exact
as well. Bounds are compared with a margin above their rounding, so pruning
never changes a result, and ties go to the lower index.

A round is one pass over the stored parts. Tasks give out one sum per entry and
position that they met, so what is shuffled and what comes back to the driver
is bounded by ``PARTS * ENTRIES`` times the width of a part, whatever the rows.

Inputs and their results: a row goes if its vector is null, holds a null, NaN
or infinite component, or is not of the table's dimension (the most frequent
length that divides into the parts and is not 0; ties to the longer one);
components are held within ``+-sqrt(2**60 / dimension)``, so that every distance
fits a long; ids order the initial entries ascending, then by the components,
null ids last; equal ids and repeated rows are coded each; with fewer rows than
entries the codebook is shorter; null labels are one group; sums beyond a long
are given as the largest long; columns other than vec_id, embedding and label
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from lisible.llm.common import join_on_hot_key, read, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Pivots per part position, and entries that are evaluated before pruning.
PIVOTS, FIRST = 6, 8
#: Parts taken together in a task.
BLOCK = 1024
#: Least distance between a bound and a true distance that may be due to rounding (bounds are held in 32 bits), relative to the distances compared.
MARGIN = 1e-5
#: A block's entries are evaluated together if more than one in DENSE is left by the bounds.
DENSE = 6
LONG_MAX = (1 << 63) - 1


def integer_vectors(vectors: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, label, parts) of the kept rows, ``parts`` all integer components; and the dimension, 0 without rows."""
    rows = vectors.select("vec_id", "label", F.col(vector).cast("array<double>").alias("_v")).where(
        F.col("_v").isNotNull() & ~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    sizes = rows.groupBy(F.size("_v").alias("size")).agg(F.count(F.lit(1)).alias("n")) \
        .where((F.col("size") > 0) & (F.col("size") % PARTS == 0)).orderBy(F.desc("n"), F.desc("size")).first()
    if sizes is None:
        return rows.where(F.lit(False)).select("vec_id", "label", F.col("_v").cast("array<bigint>").alias("parts")), 0
    bound = float(int((2.0 ** 60 / sizes["size"]) ** 0.5))
    whole = F.transform("_v", lambda x: F.floor(F.greatest(F.least(x * F.lit(float(SCALE)), F.lit(bound)), F.lit(-bound))).cast("bigint"))
    return rows.where(F.size("_v") == F.lit(sizes["size"])).select("vec_id", "label", whole.alias("parts")), sizes["size"]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``a`` and rows of ``b`` (integers), all against all."""
    most = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    if 4 * a.shape[1] * most * most < 1 << 52:  # every product and sum is a whole number that a double holds
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2.0 * (x @ y.T) + (y * y).sum(1)[None, :]).astype(np.int64)
    out = np.zeros((len(a), len(b)), np.int64)
    for j in range(a.shape[1]):
        d = a[:, j][:, None] - b[:, j][None, :]
        out += d * d
    return out


def choose_pivots(entries: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Entries that lie far apart: the first, then always the one farthest from those chosen."""
    chosen = [0]
    least = squared(entries, entries[:1])[:, 0]
    while len(chosen) < min(count, len(entries)):
        chosen.append(int(np.argmax(least)))
        least = np.minimum(least, squared(entries, entries[chosen[-1]:chosen[-1] + 1])[:, 0])
    return entries[chosen]


def nearest(parts: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, from_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of every part's nearest entry, ties to the lower index; and how many were evaluated.

    ``to_pivots`` (part, pivot) and ``from_pivots`` (entry, pivot) are distances, not squared.
    """
    bound = np.zeros((len(parts), len(entries)), np.float32)
    gap = np.empty_like(bound)
    near, far = to_pivots.astype(np.float32), from_pivots.astype(np.float32)
    for j in range(near.shape[1]):
        np.subtract(near[:, j][:, None], far[:, j][None, :], out=gap)
        np.maximum(bound, np.abs(gap, out=gap), out=bound)
    slack = MARGIN * (to_pivots.max(axis=1, initial=0.0) + from_pivots.max(initial=0.0) + 1.0)
    first = min(FIRST, len(entries))
    order = np.argpartition(bound, first - 1, axis=1)[:, :first] if first < len(entries) else np.tile(np.arange(len(entries)), (len(parts), 1))
    diff = parts[:, None, :] - entries[order]
    found = (diff * diff).sum(axis=2)
    best = found.min(axis=1)
    index = np.where(found == best[:, None], order, len(entries)).min(axis=1)
    # the rest in the order of their bounds; a bound beyond the best distance ends it
    left = bound <= (np.sqrt(best.astype(np.float64)) * (1 + MARGIN) + slack)[:, None]
    np.put_along_axis(left, order, False, axis=1)
    evaluated = order.size
    if DENSE * int(left.sum()) > left.size:
        found = squared(parts, entries)
        index = found.argmin(axis=1)
        return index, np.take_along_axis(found, index[:, None], axis=1)[:, 0], evaluated + found.size
    row, entry = np.nonzero(left)
    if len(row):
        by_bound = np.lexsort((bound[row, entry], row))
        row, entry = row[by_bound], entry[by_bound]
        wave = np.arange(len(row)) - np.searchsorted(row, row)
        limit = 0
        while len(row):
            limit += FIRST
            now = wave < limit
            r, e = row[now], entry[now]
            diff = parts[r] - entries[e]
            d = (diff * diff).sum(axis=1)
            evaluated += len(r)
            order = np.lexsort((e, d, r))
            r, e, d = r[order], e[order], d[order]
            head = np.ones(len(r), bool)
            head[1:] = r[1:] != r[:-1]
            r, e, d = r[head], e[head], d[head]
            better = (d < best[r]) | ((d == best[r]) & (e < index[r]))
            best[r[better]], index[r[better]] = d[better], e[better]
            row, entry, wave = row[~now], entry[~now], wave[~now]
            keep = bound[row, entry] <= np.sqrt(best[row].astype(np.float64)) * (1 + MARGIN) + slack[row]
            row, entry, wave = row[keep], entry[keep], wave[keep]
    return index, best, evaluated


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width) if len(column) else np.zeros((0, width), np.int64)


def with_pivot_distances(vectors: DataFrame, dimension: int, pivots: list[np.ndarray]) -> DataFrame:
    """Add ``far``: the squared distances of each part to its pivots, part after part."""
    width = dimension // PARTS
    schema = StructType([*vectors.schema.fields, StructField("far", ArrayType(LongType()))])

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(2), dimension).astype(np.int64)
            far = np.concatenate([squared(x[:, p * width:(p + 1) * width], pivots[p]) for p in range(PARTS)], axis=1)
            at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * far.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(at, pa.array(far.reshape(-1)))], names=schema.names)

    return vectors.mapInArrow(run, schema)


class Search:
    """Nearest entries of a task's rows, part by part; codebooks and pivots are bounded by parameters."""

    def __init__(self, codebooks: list[np.ndarray], pivots: list[np.ndarray]):
        self.codebooks, self.pivots = codebooks, pivots
        self.from_pivots = [np.sqrt(squared(c, p).astype(np.float64)) for c, p in zip(codebooks, pivots)]

    def __call__(self, x: np.ndarray, far: np.ndarray):
        """(index, squared distance) per part, rows times PARTS each."""
        width, n = x.shape[1] // PARTS, far.shape[1] // PARTS
        index, dist = np.zeros((len(x), PARTS), np.int64), np.zeros((len(x), PARTS), np.int64)
        for start in range(0, len(x), BLOCK):
            rows = slice(start, start + BLOCK)
            near = np.sqrt(far[rows].astype(np.float64))
            for p in range(PARTS):
                index[rows, p], dist[rows, p], _ = nearest(
                    x[rows, p * width:(p + 1) * width], near[:, p * n:(p + 1) * n], self.codebooks[p], self.from_pivots[p])
        return index, dist


def entry_sums(table: DataFrame, dimension: int, codebooks: list[np.ndarray], pivots: list[np.ndarray]) -> DataFrame:
    """(entry, n, sums): parts assigned to each entry (numbered through the part positions) and their component sums."""
    width = dimension // PARTS

    def run(batches):
        search = Search(codebooks, pivots)
        size = len(codebooks[0])
        sums, counts = np.zeros((PARTS * size, width), np.int64), np.zeros(PARTS * size, np.int64)
        for batch in batches:
            x, far = _matrix(batch.column(0), dimension).astype(np.int64), _matrix(batch.column(1), PARTS * len(pivots[0]))
            index, _ = search(x, far)
            for p in range(PARTS):
                np.add.at(sums, index[:, p] + p * size, x[:, p * width:(p + 1) * width])
                counts += np.bincount(index[:, p] + p * size, minlength=PARTS * size)
        used = np.flatnonzero(counts)
        at = pa.array(np.arange(len(used) + 1, dtype=np.int32) * width)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), pa.ListArray.from_arrays(at, pa.array(sums[used].reshape(-1)))],
                                         names=["entry", "n", "sums"])

    found = table.select("parts", "far").mapInArrow(run, "entry bigint, n bigint, sums array<bigint>")
    each = found.select("entry", "n", F.posexplode("sums").alias("at", "s"))
    return each.groupBy("entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))


def refine(table: DataFrame, dimension: int, codebooks: list[np.ndarray], pivots: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round; an entry without parts stays as it is."""
    out, size = [c.copy() for c in codebooks], len(codebooks[0])
    for r in entry_sums(table, dimension, codebooks, pivots).collect():  # PARTS x ENTRIES x width at most
        out[r["entry"] // size][r["entry"] % size, r["at"]] = int(r["s"]) // r["n"]
    return out


def encode(table: DataFrame, dimension: int, codebooks: list[np.ndarray], pivots: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code, error of every row of the stored table."""
    def run(batches):
        search = Search(codebooks, pivots)
        for batch in batches:
            index, dist = search(_matrix(batch.column(2), dimension).astype(np.int64), _matrix(batch.column(3), PARTS * len(pivots[0])))
            code = ["".join(f"{i:02x}" for i in row) for row in index.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(dist.sum(axis=1))],
                                             names=["vec_id", "label", "code", "error"])

    kinds = dict(table.dtypes)
    return table.select("vec_id", "label", "parts", "far").mapInArrow(
        run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def codebooks_text(codebooks: list[np.ndarray]) -> str:
    """All entries' components, by part, entry and position."""
    return ",".join(str(v) for c in codebooks for v in c.reshape(-1).tolist())


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of the kept rows, and the codebook of every part position."""
    kept, dimension = integer_vectors(vectors)
    if not dimension:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")), [np.zeros((0, 0), np.int64)] * PARTS
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(ENTRIES).select("parts").collect()  # ENTRIES rows
    start = np.array([r["parts"] for r in first], np.int64)
    width = dimension // PARTS
    codebooks = [np.ascontiguousarray(start[:, p * width:(p + 1) * width]) for p in range(PARTS)]
    pivots = [choose_pivots(c) for c in codebooks]
    table = stored(with_pivot_distances(kept, dimension, pivots), "vector-parts")
    for _ in range(rounds):
        codebooks = refine(table, dimension, codebooks, pivots)
    return encode(table, dimension, codebooks, pivots), codebooks


def _within_long(total) -> F.Column:
    return F.least(total, F.lit(LONG_MAX).cast("decimal(38,0)")).cast("bigint")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = compress(read(spark, sf_dir, "embeddings"))
    coded = stored(coded, "vector-codes")
    per_label = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count(F.lit(1)).alias("n"))
    told = join_on_hot_key(coded, per_label, ["label"], "n", coded.count())
    digest = hashlib.sha256(codebooks_text(codebooks).encode()).hexdigest()
    return told.select("vec_id", "code", "error", _within_long(F.col("total")).alias("label_error"), F.lit(digest).alias("codebooks_sha256"))


def oracle(rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES) -> str:
    """The same in SQL, every part against every entry; whole numbers in doubles are exact at the magnitudes given."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT x.k, x.p, arg_min(b.e, struct_pack(d := x.sq + b.sq - 2 * list_inner_product(x.v, b.v), e := b.e)) AS e,
    min(x.sq + b.sq - 2 * list_inner_product(x.v, b.v)) AS d
  FROM x JOIN b{r} b ON b.p = x.p GROUP BY x.k, x.p)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (
  SELECT p, e, list(m ORDER BY i) AS v FROM (
    SELECT x.p, a.e, i, floor(sum(x.v[i]) / count(*)) AS m
    FROM a{r} a JOIN x ON x.k = a.k AND x.p = a.p, (SELECT unnest(generate_series(1, (SELECT max(len(v)) FROM x))) AS i) GROUP BY x.p, a.e, i) GROUP BY p, e),
b{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.v, b.v) AS v, list_inner_product(coalesce(m.v, b.v), coalesce(m.v, b.v)) AS sq
  FROM b{r} b LEFT JOIN m{r} m ON m.p = b.p AND m.e = b.e)""")
    return f"""
WITH good AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS k, vec_id, label, v FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
x AS MATERIALIZED (
  SELECT k, p, v, list_inner_product(v, v) AS sq FROM (
    SELECT k, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS v FROM good, (SELECT unnest(range({parts})) AS p))),
b0 AS (SELECT p, k - 1 AS e, v, sq FROM x WHERE k <= {entries}),{",".join(steps)},
digest AS (
  SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (
    SELECT p, e, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM b{rounds})),
coded AS (SELECT k, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY k)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN good USING (k), digest
"""


ORACLE = oracle()
