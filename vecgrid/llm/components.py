"""Connected components of a distributed graph by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecgrid.llm.common import stored

ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for each node of ``links`` (a, b).

    Each round links all larger neighbours of a node to its smallest neighbour, then all smaller
    ones likewise, until nothing changes: O(log n) rounds on paths, trees and cliques alike.
    Rounds are grouped aggregations and joins on the node; every round is a written table.
    A star of any size is safe: minima are aggregated before the shuffle, and the join back to
    the links is a plain shuffle join of two scans, which adaptive execution can split.
    Links with a NULL end and loops do not matter.
    """
    links = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u > v")
        .distinct(),
        "cc",
    )
    if links.isEmpty():
        return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = None
    for _ in range(ROUNDS):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stored(_star(both, F.col("v") > F.col("u")), "cc-large")
        small = stored(_star(large, F.lit(True)), "cc-small")
        state = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        links = small
        if state == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = state
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")


def _star(links: DataFrame, which) -> DataFrame:
    """Link the chosen neighbours v of each node u, and u itself, to the least of u and its neighbours."""
    least = stored(
        links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least"
    )
    moved = links.join(least, "u").filter(which).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
