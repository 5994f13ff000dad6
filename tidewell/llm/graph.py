"""Connected components of graphs too large for any one machine, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.tables import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


#: A node of more edges than this is a hub; and so many hubs may be broadcast. There are at most 2 |edges| / HUB of them.
HUB, BROADCAST_HUBS = 2000, 200_000


def _join_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` (a, b) with ``m`` of their node a. ``nodes``: a written table a, m, n, with the edges of each in n.

    Edges of hubs stay where they are and meet the hubs by broadcast, all others are shuffled, so no task gets the
    edges of a hub. Where hubs are too many to broadcast only the larger ones count as such.
    """
    least = HUB
    while (many := nodes.where(F.col("n") > least).limit(BROADCAST_HUBS + 1).count()) > BROADCAST_HUBS:
        least *= 8
    if not many:
        return edges.join(nodes.select("a", "m"), "a")
    hubs = F.broadcast(nodes.where(F.col("n") > least).select("a", "m"))
    others = edges.join(hubs, "a", "left_anti").join(nodes.where(F.col("n") <= least).select("a", "m"), "a")
    return edges.join(hubs, "a").unionByName(others)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the root is the least node of its component.

    Large star: a node's larger neighbours move to its least one. Small star: so do its smaller ones. Both are
    an aggregation and a join that spreads the edges of hubs; each round is written out, which cuts the lineage.
    When a round changes nothing, all nodes hang on their roots.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(now)
    before = None
    while (state := _state(now)) != before:
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = _join_nodes(both.where("b > a"), materialize(least)).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large)
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
        small = _join_nodes(large, low).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = materialize(small.where("a <> b").distinct())
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
