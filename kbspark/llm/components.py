"""Connected components of an edge table, by alternating large-star and small-star steps on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.shared import split_join, written


def _with_least(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` (a, b) with ``m``, the least ``b`` of each ``a``."""
    return split_join(rows, rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "a", total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = _with_least(both, 2 * total).withColumn("m", F.least("a", "m"))
    return met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    moved = _with_least(down, total).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.union(down.groupBy("a").agg(F.min("b").alias("b"))).distinct()


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (long columns ``a`` and ``b``): ``root`` is the least node
    that a path of edges reaches.

    Each round ships edges only, joins on nodes (the few that hold a large share of all edges by broadcast), and
    writes its result, so a lost executor costs one round at most. Rounds grow with the logarithm of the longest path; a star, as most groups of copies are, takes two.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    state = _state(now)
    for k in range(1, max_rounds + 1):
        now = written(_small_star(_large_star(now, state[0]), state[0]), f"{name}-{k}")
        last, state = state, _state(now)
        if state == last:
            roots = now.select(F.col("b").alias("node")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
