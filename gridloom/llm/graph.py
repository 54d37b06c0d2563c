"""Connected components of an edge table by alternating large-star and small-star turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Edges that a task reads; small graphs take few tasks.
PER_TASK = 100_000


def connected_components(edges: DataFrame, most_turns: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a long, b long); component is its smallest node.

    A turn points all larger neighbours of a node to its smallest neighbour, then all smaller
    ones; the minimum is a partial aggregate, so a hub's edges are reduced before they move.
    The turns end when the edges no longer change; each is cut off with a checkpoint.
    """
    pairs = edges.select("a", "b").where(F.col("a") != F.col("b"))
    now = checkpoint(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most_turns):
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == before:
            break
        before = tuple(row)
        now = now.coalesce(max(1, -(-row[0] // PER_TASK)))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        up = small.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = checkpoint(small.select("a", F.col("m").alias("b")).unionByName(up).distinct())
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return roots.unionByName(now.select(F.col("a").alias("node"), F.col("b").alias("component")))
