"""Connected components of an undirected graph, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfactor.llm.common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link every neighbour of a node to the smallest node near it: larger neighbours if large, else the others.

    The minimum is a partial aggregate and the join back on the node is a plain equi-join, so a hub's
    neighbours are never gathered in one task's memory.
    """
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    linked = both.join(low, "a")
    if large:
        out = linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            low.select("a", F.col("m").alias("b"))
        )
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(a, b) links -> (node, root): root is the smallest node reachable. Nodes without a link are absent."""
    edges = materialize(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = None
    for _ in range(max_rounds):
        before, edges = edges, materialize(_star(_star(edges, True), False))
        discard(before)
        # The edge set stands still once every node hangs from its root; the sum of hashes tells.
        now = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
        ).first()
        if seen == now:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
