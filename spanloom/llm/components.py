"""Connected components of an edge table, without ever gathering it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import checkpoint

MOST_ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    """a, least: the smallest of a node and its neighbours; pre-aggregated before the shuffle."""
    return edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))


def _stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one root that itself hangs on none: the components are found."""
    nodes = edges.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    nodes = nodes.union(edges.select(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    counted = nodes.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return counted.where((F.col("hangs") > 1) | ((F.col("hangs") > 0) & (F.col("holds") > 0))).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of the edges (a, b).

    Alternating star contraction: a large-star round hangs each node's larger neighbours on its
    smallest one, a small-star round does so with the smaller neighbours. The number of rounds
    grows as the logarithm of the longest path; no round is run on what is stars already, since each
    shuffle also costs the driver a thread for a minute. Each round's edges go to the checkpoint folder,
    which cuts the lineage and lets lost executors' work be read again. A hub's edges are split
    by the adaptive skew join, its minimum is a pre-aggregated sum.
    """
    edges = checkpoint(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(MOST_ROUNDS):
        if _stars(edges):
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        )
        small = large.join(large.groupBy("a").agg(F.min("b").alias("least")), "a")
        small = small.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("b")))).alias("e"), "least")
        edges = checkpoint(small.select("e.a", F.col("least").alias("b")).where("a <> b").distinct())
    else:
        raise RuntimeError("components: no fixed point")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
