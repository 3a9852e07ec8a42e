"""Minimum spanning forest of a weighted graph."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecgrid.operators.skew import merge_lookup
from vecgrid.session import stable

REMAINDER = 200_000  # edges between merged components that one task finishes, whatever the size of the input


def spanning_forest(edges: DataFrame, remainder: int = REMAINDER) -> DataFrame:
    """Minimum spanning forest (src < dst, weight) of edges (src, dst, weight).

    Direction, loops and parallel edges do not matter. Edges are ordered by
    (weight, src, dst), which makes the forest unique. Boruvka rounds: every
    component takes its least edge, joined components are merged, and only the
    least edge between two components is carried on. The number of components at
    least halves each round. Every aggregation combines before it shuffles, and labels are
    looked up with a merge join that copes with a component of any size and keeps tables of nodes off the driver. When a round leaves at most ``remainder`` edges, one
    task sorts these few and ends the forest, instead of many rounds that do next to nothing.
    """
    live = stable(
        edges.filter(F.col("src") != F.col("dst"))
        .groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
        .agg(F.min(F.col("weight").cast("double")).alias("w"))
        .select(F.col("u").alias("cu"), F.col("v").alias("cv"), "w", "u", "v")
    )
    taken: list[DataFrame] = [live.select("u", "v", "w").limit(0)]
    while not live.isEmpty():
        edge = ["w", "u", "v"]
        ends = live.select(F.col("cu").alias("c"), F.col("cv").alias("o"), *edge).unionByName(
            live.select(F.col("cv").alias("c"), F.col("cu").alias("o"), *edge)
        )
        least = ends.groupBy("c").agg(F.min(F.struct(*edge, "o")).alias("m")).select("c", "m.*")
        # An edge chosen from both sides makes a pair, whose smaller label is the root.
        chosen = stable(
            least.groupBy(*edge).agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min_by("o", "c").alias("o"))
        )
        taken.append(chosen.select("u", "v", "w"))
        single = F.col("lo") == F.col("hi")
        links = F.array(
            F.struct(F.col("lo").alias("c"), F.when(single, F.col("o")).otherwise(F.col("lo")).alias("p")),
            F.struct(F.when(~single, F.col("hi")).alias("c"), F.col("lo").alias("p")),
        )
        parents = chosen.select(F.explode(links).alias("l")).select("l.*").filter(F.col("c").isNotNull())
        roots = _roots(stable(parents))
        moved = merge_lookup(live, roots.select(F.col("c").alias("cu"), F.col("p").alias("ru")), ["cu"])
        moved = merge_lookup(moved, roots.select(F.col("c").alias("cv"), F.col("p").alias("rv")), ["cv"])
        live = stable(
            moved.filter(F.col("ru") != F.col("rv"))
            .groupBy(F.least("ru", "rv").alias("cu"), F.greatest("ru", "rv").alias("cv"))
            .agg(F.min(F.struct(*edge)).alias("m"))
            .select("cu", "cv", "m.*")
        )
        if 0 < live.count() <= remainder:
            schema = taken[0].schema
            last = live.select("cu", "cv", *edge).repartition(1).sortWithinPartitions(*edge)
            taken.append(stable(last.mapInArrow(_finish, schema)))
            break
    return reduce(lambda a, b: a.unionByName(b), taken).select(
        F.col("u").alias("src"), F.col("v").alias("dst"), F.col("w").alias("weight")
    )


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kruskal's algorithm over sorted edges (cu, cv, w, u, v) between components: the edges (u, v, w) that join two."""
    parent: dict = {}

    def find(c):
        while (p := parent.setdefault(c, c)) != c:
            parent[c] = c = parent.setdefault(p, p)
        return c

    for batch in batches:
        joins = []
        for a, b in zip(batch["cu"].to_pylist(), batch["cv"].to_pylist(), strict=True):
            a, b = find(a), find(b)
            joins.append(a != b)
            parent[a] = b
        yield batch.filter(pa.array(joins, pa.bool_())).select(["u", "v", "w"])


def _roots(parents: DataFrame) -> DataFrame:
    """Follow parent links (c, p) to the root; each pass makes two jumps, which quadruples the reach."""
    def jump(links: DataFrame) -> DataFrame:
        table = links.select(F.col("c").alias("p"), F.col("p").alias("g"))
        return merge_lookup(links, table, ["p"])

    while True:
        jumped = stable(jump(jump(parents).select("c", F.col("g").alias("p"))))
        if jumped.filter(F.col("p") != F.col("g")).isEmpty():
            return jumped.select("c", "p")
        parents = jumped.select("c", F.col("g").alias("p"))
