"""Connected components over written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadspark.llm.common import join_groups, written


def _digest(edges: DataFrame) -> tuple:
    """How many edges there are, and two checksums of them."""
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.crc32(F.concat_ws(" ", "a", "b").cast("binary")))).first())


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """node and component, the smallest node reachable, for every node of edges(a, b).

    Alternating rounds: every node's neighbours no smaller than it, then those no larger than it,
    are hung on the smallest of them. Both keep the edges' number in bounds and a component's
    height falls by a constant factor. The minimum of a group is taken before it moves, and that of a
    node with many neighbours is broadcast to them. Each round is written, so that lost executors
    cost one round at most.
    """
    star = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = _digest(star)
    for _ in range(max_rounds):
        rows = 2 * before[0]
        # large star: neighbours larger than a node go to the smallest one around it
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = written(join_groups(both, least, "a", "n", rows, "inner").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), name)
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        ends = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))))
        star = written(join_groups(large, low, "a", "n", rows, "inner").select(ends.alias("e")).select("e.*").where("a <> b").distinct(), name)
        now = _digest(star)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = star.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(star.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
