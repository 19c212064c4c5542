"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a minimum per node (summed up within tasks first) and a join in
which nodes with very many links (a bounded number of them) are answered by
broadcast, so a hub is never gathered; each round is written under the
shared checkpoint folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lisible.llm.common import join_on_hot_key, stored


def _with_least(rows: DataFrame, among: DataFrame, total: int) -> DataFrame:
    """Rows (a, b) with ``m``, the smallest ``b`` that ``a`` has in ``among``."""
    least = among.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n"))
    return join_on_hot_key(rows, least, ["a"], "_n", total).drop("_n")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    moved = _with_least(both.where("b > a"), both, 2 * n).select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    return moved.where("a <> b").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    moved = _with_least(down, down, n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(down.groupBy("a").agg(F.min("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("bigint"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links(a bigint, b bigint)``; the component is its smallest node.

    Links of a node with itself and null ends are ignored; an empty table gives no rows.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = _state(edges)
    while True:
        edges = stored(_small_star(_large_star(edges, before[0]), before[0]), "links")
        after = _state(edges)
        if after == before:
            break
        before = after
    # stars now: every node but the centre points at the centre
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
