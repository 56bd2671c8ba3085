"""Connected components of large graphs: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of every node of ``edges`` (a long, b long).

    Each round hangs neighbours under the least node nearby, so chains of any length end after about log rounds. The edges
    never leave the cluster; a node with most of the edges is a join key that can be split, never one task's group.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        before, now = now, cut(_small(_large(now)))
        discard(before)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen == mark:
            break
        seen = mark
    # Stable edges are stars: each node to its component's least.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b")).distinct()


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_a"), F.least("a", "_m").alias("_m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("_a")).filter("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """``edges`` have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_a"), "_m")
    hung = edges.join(least, F.col("a") == F.col("_a")).filter("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return hung.union(least.select("_a", "_m")).distinct()
