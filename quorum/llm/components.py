"""Connected components of an edge table, by alternating star contraction.

Each round is two group-and-join steps on (node, neighbour) rows; every
node's edges are re-pointed to the smallest neighbour, so long chains halve.
Groups are reduced by ``min`` (combined before the shuffle), and the joins
split a hot node's rows (adaptive execution), so no task holds a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import saved


def _state(edges: DataFrame):
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (both.join(low, "a").where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"))


def _small_star(e: DataFrame) -> DataFrame:
    e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(low, "a")
    return (moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge; the component is its
    smallest node.  Self-edges and repeated edges are allowed."""
    e = saved(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
              .where("a <> b").distinct(), "edges")
    before = _state(e)
    while before[0]:
        e = saved(_small_star(_large_star(e)), "edges")
        now = _state(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
