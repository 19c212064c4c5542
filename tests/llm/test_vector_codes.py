"""Vector codes against plain integer k-means, with awkward rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lisible.llm import vector_codes as V

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, rounds=4, parts=4, entries=256):
    """{row number: (code, error)} and the digest, by comparing every part with every entry."""
    kept = [(i, r[0], [math.floor(1024 * float(np.float32(x))) for x in r[1]]) for i, r in enumerate(rows)
            if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    order = sorted(kept, key=lambda r: (r[1] is None, r[1] or 0, r[2]))
    width = len(order[0][2]) // parts
    cut = lambda v: [v[p * width:(p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, _, v in order[:entries]] for p in range(parts)]

    def assign():
        out = {}
        for i, _, v in kept:
            each = []
            for p, x in enumerate(cut(v)):
                d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in books[p]]
                each.append((d.index(min(d)), min(d)))
            out[i] = each
        return out

    for _ in range(rounds):
        told = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v)[p] for i, _, v in kept if told[i][p][0] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    text = ",".join(str(x) for b in books for e in b for x in e)
    return {i: ("".join(f"{e:02x}" for e, _ in x), sum(d for _, d in x)) for i, x in assign().items()}, hashlib.sha256(text.encode()).hexdigest()


def run(spark, tmp_path, rows, schema=SCHEMA, name="t"):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name / "embeddings.parquet"))
    return [tuple(r) for r in V.op11_vector_codes(spark, str(tmp_path / name)).collect()]


def expected(rows):
    told, digest = plain(rows)
    labels = {}
    for i, (_, error) in told.items():
        labels[rows[i][2]] = labels.get(rows[i][2], 0) + error
    return [(rows[i][0], code, error, labels[rows[i][2]], digest) for i, (code, error) in told.items()]


key = lambda rows: sorted(rows, key=repr)


def test_equals_plain_kmeans_with_awkward_rows(spark, tmp_path):
    g = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in g.normal(0, 0.3, 16).astype(np.float32)], [None, 1, 1, 2][i % 4]) for i in range(330)]
    rows += [rows[3], rows[3], (3, rows[9][1], 2), (None, rows[4][1], 1), (400, [0.5] * 16, 3), (401, [-0.5] * 16, 3),
             (402, None, 1), (403, [0.1] * 15 + [None], 1), (404, [float("nan")] * 16, 1), (405, [float("inf")] + [0.0] * 15, 1)]
    assert key(run(spark, tmp_path, rows)) == key(expected(rows))


def test_few_rows_ties_and_negative_means(spark, tmp_path):
    rows = [(7, [-0.001, 0.0, 0.25, 0.25], 1), (5, [0.002, 0.0, 0.25, 0.5], 1), (6, [0.002, 0.0, 0.25, 0.5], None)]
    assert key(run(spark, tmp_path, rows)) == key(expected(rows))


def test_empty_tables_and_other_dimensions(spark, tmp_path):
    assert run(spark, tmp_path, [], name="a") == []
    assert run(spark, tmp_path, [(1, None, 1), (2, [], 1), (3, [0.5] * 3, 1)], name="b") == []
    rows = [(1, [0.5] * 4, 1), (2, [0.25] * 4, 1), (3, [0.5] * 8, 1), (4, [0.5] * 5, 1)]
    assert [r[:3] for r in sorted(run(spark, tmp_path, rows, name="c"))] == [(1, "00000000", 0), (2, "01010101", 0)]


def test_largest_components_do_not_overflow(spark, tmp_path):
    rows = [(i, [3e38 * (-1) ** (i + j) for j in range(8)], 1) for i in range(4)] + [(9, [1e-3] * 8, 1)]
    told = run(spark, tmp_path, rows)
    assert len(told) == 5 and all(r[2] == 0 for r in told)


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, [0.5] * 4, 1, "x")], SCHEMA + ", parts string") \
        .withColumns({c: F.lit(1) for c in ("far", "_v", "code", "error", "n", "total")})
    coded, _ = V.compress(rows)
    assert coded.columns == ["vec_id", "label", "code", "error"] and coded.count() == 1


@pytest.mark.parametrize("scale", [50, 3_000, 10 ** 8])
def test_pruned_search_is_exact_and_evaluates_less(scale):
    g = np.random.default_rng(scale)
    centres = g.integers(-scale, scale, (20, 8))
    entries = centres[g.integers(0, 20, 256)] + g.integers(-scale // 20 - 1, scale // 20 + 1, (256, 8))
    entries[200] = entries[3]  # ties go to the lower index
    parts = np.concatenate([entries[[200, 7]], centres[g.integers(0, 20, 500)] + g.integers(-scale // 20 - 1, scale // 20 + 1, (500, 8))])
    pivots = V.choose_pivots(entries)
    far = lambda x: np.sqrt(V.squared(x, pivots).astype(np.float64))
    index, dist, evaluated = V.nearest(parts, far(parts), entries, far(entries))
    full = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (index == full.argmin(axis=1)).all() and (dist == full.min(axis=1)).all()
    assert evaluated < full.size // 3
