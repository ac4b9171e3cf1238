"""Connected components of large graphs with DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _with_least(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) with ``m``, the least b of each a.  The least values are
    written first: the join then has two plain exchanges, and the rows of a node
    with very many neighbours can be split over tasks."""
    least = materialize(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    return edges.join(least, "a")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b: longs); root: the least
    node that can be reached.

    Alternates large-star and small-star rounds (each links a node's neighbours
    to the least of them), whose number grows with the logarithm of the longest
    chain; each round is written, so that a lost executor costs one round.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    was = None
    while (state := _state(now)) != was:
        was = state
        both = materialize(now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
        large = _with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "large")
        small = _with_least(large)
        linked = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        now = materialize(linked.where("a <> b").distinct(), "small")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
