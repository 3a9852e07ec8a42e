"""k-nearest-neighbour graphs over MinHash signatures and over coordinates.

Neither operator emits all pairs of a bucket beyond a fixed size. Both cut sorted data into pieces of
a fixed number of rows, so a bucket, a cell or a set of copies that holds much
of the data is many pieces, not one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from math import ceil, exp, log, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecgrid.operators.grid import valid
from vecgrid.operators.ranking import ranked
from vecgrid.operators.skew import lookup_join, merge_lookup
from vecgrid.session import stable

MAX_TREES = 64  # trees of a prefix forest unless told otherwise
POINT_ROWS = 512  # points per block
CHUNK = 1 << 21  # distances a task holds at a time


# ---------------------------------------------------------------- MinHash


def knn_minhash(
    df: DataFrame,
    id_col: str,
    sig: str,
    permutations: int,
    k: int = 20,
    trees: int | None = None,
    kc: int = 10,
) -> DataFrame:
    """Neighbours by a prefix forest over signatures: (src, dst, matches, weight, rank), at most k per src.

    Rows with equal signatures are one node with its k + 1 smallest ids, so copies, however many, take one place. A tree reads
    the signature from one position on, taken round. Nodes that begin alike in a tree are a group, and a group of at most
    ``k * kc`` nodes is compared in full: with a tree at every position (the default, up to ``MAX_TREES``) no pair with any match is
    lost. A larger group goes on to longer prefixes: its nodes are sorted by the rest of the signature, which puts the deepest
    prefixes side by side, and cut into overlapping pieces of ``k * kc``, so that every node meets at least half as many of those
    with which it shares the longest prefixes, in each tree. ``kc`` is thus the recall parameter, and it matters only for such groups.
    All candidates are scored by equal positions; the k best ids with at least one match are kept (ties: smaller id).
    ``weight`` is 1 - estimated Jaccard similarity.

    Rows that repeat an id and signature count once, and an id is never its own neighbour. Rows without signature have no neighbours.
    Work is at most nodes x trees x 2 k kc comparisons whatever the distribution of signatures; a node leaves at most k rows
    in each group or piece, so what is shuffled and written grows with the nodes, not with the pairs.
    """
    trees = min(permutations, MAX_TREES) if trees is None else trees
    if not 1 <= trees <= permutations:
        raise ValueError("more trees than permutations")
    every = stable(df.filter(F.col(sig).isNotNull()).select(F.col(id_col).alias("id"), F.col(sig).alias("sig")).distinct())
    bad = every.filter(F.size("sig") != permutations)
    if not bad.isEmpty():
        raise ValueError(f"signatures must have {permutations} positions")
    first = Window.partitionBy("sig").orderBy("id")
    nodes = stable(
        every.withColumn("_n", F.row_number().over(first))
        .filter(F.col("_n") <= k + 1)
        .groupBy("sig")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"))
        .withColumn("id", F.get("ids", F.lit(0)))
    )
    met = _forest_groups(nodes.select("id", "sig"), permutations, trees, max(2, k * kc))
    # The k best of a node are among its k best of each group.
    every_group = _best_of_groups(met, k).groupBy("src").agg(F.flatten(F.collect_list("near")).alias("near"))
    best = F.slice(F.array_sort(F.array_distinct("near")), 1, k)
    near = stable(every_group.select("src", F.explode(best).alias("s")).select("src", "s.dst", (-F.col("s.m")).alias("matches")))

    # Nodes back to ids: its own copies, then those of its neighbours.
    candidates = near.join(nodes.select(F.col("id").alias("dst"), "ids"), "dst").select(
        F.col("src").alias("node"), "matches", F.explode("ids").alias("dst")
    )
    own = nodes.select(F.col("id").alias("node"), F.lit(permutations).alias("matches"), F.explode("ids").alias("dst"))
    closest = Window.partitionBy("node").orderBy(F.desc("matches"), "dst")
    lists = (
        candidates.unionByName(own)
        .withColumn("_n", F.row_number().over(closest))
        .filter(F.col("_n") <= k + 1)
        .groupBy("node")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("matches")).alias("m"), "dst"))).alias("near"))
    )
    per_node = stable(nodes.select("sig", F.col("id").alias("node")).join(lists, "node").select("sig", "near"))
    others = F.slice(F.filter("near", lambda s: s["dst"] != F.col("id")), 1, k)
    return (
        lookup_join(every, per_node, ["sig"])
        .select(F.col("id").alias("src"), F.posexplode(others).alias("_i", "_s"))
        .select("src", F.col("_s.dst").alias("dst"), (-F.col("_s.m")).alias("matches"), (F.col("_i") + 1).alias("rank"))
        .withColumn("weight", 1 - F.col("matches") / F.lit(permutations))
        .select("src", "dst", "matches", "weight", "rank")
    )


def _forest_groups(rows: DataFrame, permutations: int, trees: int, most: int) -> DataFrame:
    """(tree, head, piece, id, sig): the nodes of each group, or of each piece of one; none has more than ``most`` nodes.

    In a piece of a large group ``sig`` is turned to the position of its tree, which leaves the number of equal positions as it is.
    """
    starts = [permutations * t // trees for t in range(trees)]
    entries = rows.select(
        "id", F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.get("sig", F.lit(p)).alias("head")) for t, p in enumerate(starts)])).alias("e")
    ).select("id", "e.*")
    sizes = entries.groupBy("tree", "head").agg(F.count("*").alias("size")).filter("size > 1")
    grouped = stable(entries.join(sizes, ["tree", "head"]))
    small = grouped.filter(F.col("size") <= most).select("tree", "head", F.lit(0).cast("bigint").alias("piece"), "id").join(rows, "id")
    small = small.select("tree", "head", "piece", "id", "sig")
    large = grouped.filter(F.col("size") > most)
    if large.isEmpty():
        return small
    at = F.element_at(F.array(*[F.lit(p) for p in starts]), F.col("tree") + 1)
    turned = F.concat(F.slice("sig", at + 1, F.lit(permutations)), F.slice("sig", F.lit(1), at))
    keyed = large.join(rows, "id").select("tree", "head", "id", turned.alias("key"))
    placed = ranked(keyed, ["key"], ["tree", "head"], "rank").select("tree", "head", "id", "key", (F.col("rank") - 1).alias("at"))
    pieces = F.array(2 * F.floor(F.col("at") / most) + 1, 2 * F.floor((F.col("at") + most // 2) / most) + 2)
    return small.unionByName(placed.select("tree", "head", F.explode(pieces).alias("piece"), "id", F.col("key").alias("sig")))


def _best_of_groups(met: DataFrame, k: int) -> DataFrame:
    """(src, near): for each node of a group its k others with most equal positions (ties: smaller id), as (-positions, dst).

    Groups are compared where they lie, so no pair is ever shuffled or written, only k a node and group.
    """
    id_type = met.schema["id"].dataType
    near = T.ArrayType(T.StructType([T.StructField("m", T.IntegerType()), T.StructField("dst", id_type)]))
    keys = ["tree", "head", "piece"]
    dealt = met.repartition(*keys).sortWithinPartitions(*keys, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the group that the last batch ended in
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            starts = _group_starts(held, keys)
            yield from _best_in(held.slice(0, starts[-1]), starts[:-1], k)
            held = held.slice(starts[-1])
        if held is not None:
            yield from _best_in(held, np.zeros(1, np.int64), k)

    return dealt.mapInArrow(run, T.StructType([T.StructField("src", id_type), T.StructField("near", near)]))


def _group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Places where a new group begins in sorted rows."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for key in keys:
        values = table[key].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _best_in(table: pa.Table, starts: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each row within its group; groups of equal size are compared together."""
    if not table.num_rows:
        return
    ids = table["id"].combine_chunks()
    sigs = table["sig"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
    sizes = np.diff(np.append(starts, table.num_rows))
    for size in np.unique(sizes[sizes > 1]):
        of_size = starts[sizes == size]
        step = max(1, CHUNK // int(size * size))
        for i in range(0, len(of_size), step):
            rows = of_size[i : i + step, None] + np.arange(size)
            x = np.ascontiguousarray(sigs[rows].transpose(2, 0, 1))
            same = np.zeros((len(rows), size, size), np.int16)
            for position in x:
                same += position[:, :, None] == position[:, None, :]
            same[:, np.arange(size), np.arange(size)] = 0
            order = same.astype(np.int32) * int(size) + np.arange(size - 1, -1, -1, dtype=np.int32)  # ids are sorted
            best = np.argpartition(order, size - k, axis=2)[:, :, size - k :] if size > k else np.broadcast_to(np.arange(size), same.shape)
            matches = np.take_along_axis(same, best, axis=2)
            kept = matches > 0
            dst = np.take_along_axis(rows[:, None, :], best, axis=2)
            offsets = np.concatenate([[0], np.cumsum(kept.sum(axis=2).ravel())]).astype(np.int32)
            found = pa.StructArray.from_arrays([pa.array(-matches[kept].astype(np.int32)), ids.take(pa.array(dst[kept]))], ["m", "dst"])
            lists = pa.ListArray.from_arrays(pa.array(offsets), found)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows.ravel())), lists], ["src", "near"])


# ---------------------------------------------------------------- coordinates


def knn_coords(
    df: DataFrame, id_col: str, coords: Sequence[str], k: int = 20, block_rows: int = POINT_ROWS
) -> DataFrame:
    """Exact Euclidean neighbours: (src, dst, weight, rank), k per row, ties by id.

    1. Rows at the same place become one point with its k + 1 smallest ids.
    2. Points are cut into blocks of equal size, one coordinate after the other, each as often as its spread asks for.
    3. The k-th distance within its own block bounds each point's search; it then
       visits just the blocks whose bounding box comes that close (see ``_reached_boxes``).
    4. The best of all visits are merged and spelled out for every row.

    ``id_col`` must be unique. Rows lacking a coordinate are left out. For more than a few coordinates boxes touch
    nearly everything: use ``pivots.knn_vectors`` there.
    """
    coords = list(coords)
    x = [f"x{i}" for i in range(len(coords))]
    usable = reduce(lambda a, b: a & b, [valid(c) for c in coords])
    rows = df.filter(usable).select(
        F.col(id_col).alias("id"), *[(F.col(c).cast("double") + F.lit(0.0)).alias(n) for c, n in zip(coords, x, strict=True)]
    )
    id_type = rows.schema["id"].dataType
    points = distinct_points(rows, x, k)
    total = points.count()
    block_rows = max(block_rows, 4 * (k + 1))
    blocks = _equal_blocks(points.select("pid", *x), x, total, block_rows)

    radius_schema = T.StructType(
        [T.StructField("pid", id_type), *[T.StructField(n, T.DoubleType()) for n in x], T.StructField("block", T.LongType()), T.StructField("r2", T.DoubleType())]
    )
    searched = stable(blocks.groupBy("block").applyInPandas(lambda p: _own_radius(p, x, k), radius_schema))
    visits = stable(_reached_boxes(searched, x))
    near = visit(visits, searched.select("pid", *x, "block"), x, ["block"], k, block_rows, id_type, _nearest)
    return rows_of_points(rows, points, near, x, k)


def distinct_points(rows: DataFrame, x: list[str], k: int) -> DataFrame:
    """One row per place: its coordinates, its k + 1 smallest ids, the smallest of them as ``pid``."""
    # A filter on row_number lets Spark prune to k + 1 rows per group before the shuffle.
    first = Window.partitionBy(*x).orderBy("id")
    return stable(
        rows.withColumn("_n", F.row_number().over(first))
        .filter(F.col("_n") <= k + 1)
        .groupBy(*x)
        .agg(F.array_sort(F.collect_list("id")).alias("ids"))
        .withColumn("pid", F.get("ids", F.lit(0)))
    )


def visit(
    visits: DataFrame,
    held: DataFrame,
    x: list[str],
    keys: list[str],
    k: int,
    block_rows: int,
    id_type: T.DataType,
    nearest: Callable[[pd.DataFrame, pd.DataFrame, list[str], int], pd.DataFrame],
) -> DataFrame:
    """(src, dst, d2): the k nearest points that each asking point finds in the blocks (``keys``) it visits."""
    # A much-visited block is searched by several tasks, each with a copy of its points.
    load = stable(visits.groupBy(*keys).agg(F.ceil(F.count("*") / (4 * block_rows)).alias("parts")))
    asking = visits.join(load, keys).withColumn("part", F.pmod(F.xxhash64("pid"), F.col("parts")))
    if not set(x) <= set(visits.columns):  # wide coordinates join last, to be shuffled once a visit
        asking = asking.join(held.select("pid", *x).hint("merge"), "pid")
    copies = held.join(load, keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pair_schema = T.StructType(
        [T.StructField("src", id_type), T.StructField("dst", id_type), T.StructField("d2", T.DoubleType())]
    )
    columns = [F.col(c).alias(c) for c in ("pid", *x, *keys, "part")]  # both sides come from one table: new columns tell them apart
    pairs = (
        asking.select(*columns)
        .groupBy(*keys, "part")
        .cogroup(copies.select(*columns).groupBy(*keys, "part"))
        .applyInPandas(lambda a, h: nearest(a, h, x, k), pair_schema)
    )
    best = Window.partitionBy("src").orderBy("d2", "dst")
    return pairs.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k).drop("_n")


def rows_of_points(rows: DataFrame, points: DataFrame, near: DataFrame, x: list[str], k: int) -> DataFrame:
    """Points back to ids: its own copies at distance 0, then those of its neighbours."""
    candidates = near.join(points.select(F.col("pid").alias("dst"), "ids").hint("merge"), "dst").select(
        F.col("src").alias("pid"), "d2", F.explode("ids").alias("id")
    )
    own = points.select("pid", F.lit(0.0).alias("d2"), F.explode("ids").alias("id"))
    closest = Window.partitionBy("pid").orderBy("d2", "id")
    lists = (
        candidates.unionByName(own)
        .withColumn("_n", F.row_number().over(closest))
        .filter(F.col("_n") <= k + 1)
        .groupBy("pid")
        .agg(F.array_sort(F.collect_list(F.struct("d2", "id"))).alias("near"))
    )
    per_point = stable(points.select("pid", *x).join(lists.hint("merge"), "pid").select(*x, "near"))
    joined = merge_lookup(rows, per_point, x)
    others = F.slice(F.filter("near", lambda s: s["id"] != F.col("id")), 1, k)
    return joined.select(F.col("id").alias("src"), F.posexplode(others).alias("_i", "_s")).select(
        "src", F.col("_s.id").alias("dst"), F.sqrt("_s.d2").alias("weight"), (F.col("_i") + 1).alias("rank")
    )


def _reached_boxes(searched: DataFrame, x: list[str]) -> DataFrame:
    """(pid, coordinates, block): the blocks whose bounding box is within the k-th distance of each point.

    Boxes and the surroundings of points meet in cells. A box has the finest level whose cells are as wide as it is, so
    it touches at most two of them per coordinate; so has the box around those points of a block that reach about equally
    far. Two boxes that overlap share a cell of the coarser of their levels: an equi-join, and nobody holds all boxes.
    """
    extent = searched.agg(*[F.min(n).alias(f"lo_{n}") for n in x], *[F.max(n).alias(f"hi_{n}") for n in x]).first()
    if extent[0] is None:
        return searched.select("pid", *x, "block").limit(0)
    extent = extent.asDict()
    span = max(max(extent[f"hi_{n}"] - extent[f"lo_{n}"] for n in x), np.finfo(float).tiny * 2.0**60)
    largest = max(*[abs(v) for v in extent.values()], span)
    finest = min(1000, 50 - ceil(log2(largest)))  # cell numbers stay exact

    def level(size: Column) -> Column:
        return F.least(F.floor(-F.log2(F.greatest(size, F.lit(span * 2.0**-60)))), F.lit(finest)).cast("int")

    reach = F.least(F.sqrt("r2") * (1 + 1e-9), F.lit(span))
    asking = searched.withColumn("reach", reach).withColumn("far", level(2 * F.col("reach")))
    low = [(F.min(n) - F.max("reach")).alias(f"lo_{n}") for n in x]
    high = [(F.max(n) + F.max("reach")).alias(f"hi_{n}") for n in x]
    asks = asking.groupBy("block", "far").agg(*low, *high).withColumnRenamed("block", "home")
    boxes = searched.groupBy("block").agg(*[F.min(n).alias(f"lo_{n}") for n in x], *[F.max(n).alias(f"hi_{n}") for n in x])
    size = F.greatest(*[F.col(f"hi_{n}") - F.col(f"lo_{n}") for n in x], F.lit(0.0))
    asks, boxes = (stable(t.withColumn("level", level(size))) for t in (asks, boxes))
    of_asks, of_boxes = ({r.level for r in t.select("level").distinct().collect()} for t in (asks, boxes))  # some dozens of numbers

    def entries(table: DataFrame, own: int, other: int, levels: set[int], strict: bool, prefix: str) -> DataFrame:
        """A row per cell and level: at its own level for finer partners, at the partners' levels for coarser ones."""
        at = [F.when(F.lit(n) < F.col("level") if strict else F.lit(n) <= F.col("level"), F.struct(F.lit(n).alias("at"), F.lit(other).alias("side"))) for n in sorted(levels)]
        native = F.struct(F.col("level").alias("at"), F.lit(own).alias("side"))
        out = table.withColumn("e", F.explode(F.filter(F.array(native, *at), lambda e: e.isNotNull()))).select(*table.columns, "e.*")
        scale = F.pow(F.lit(2.0), F.col("at"))
        for n in x:
            first, last = F.floor(F.col(f"lo_{n}") * scale), F.floor(F.col(f"hi_{n}") * scale)
            out = out.withColumn(f"{prefix}_{n}", first).withColumn(f"cell_{n}", F.explode(F.sequence(first, last)))
        return out.drop("level")

    asked = entries(asks, 0, 1, of_boxes, False, "ask").drop(*[f"lo_{n}" for n in x], *[f"hi_{n}" for n in x])
    held = entries(boxes, 1, 0, of_asks, True, "box")
    once = reduce(lambda a, b: a & b, [F.col(f"cell_{n}") == F.greatest(f"ask_{n}", f"box_{n}") for n in x])  # of all shared cells the first
    bounds = [f"{side}_{n}" for side in ("lo", "hi") for n in x]
    met = asked.join(held, ["at", "side", *[f"cell_{n}" for n in x]]).filter(once).select("home", "far", "block", *bounds)
    outside = [F.greatest(F.col(f"lo_{n}") - F.col(n), F.col(n) - F.col(f"hi_{n}"), F.lit(0.0)) for n in x]
    away = reduce(lambda a, b: a + b, [o * o for o in outside])
    points = asking.select("pid", *x, "r2", "far", F.col("block").alias("home"))
    return points.join(met, ["home", "far"]).filter(away <= F.col("r2")).select("pid", *x, "block")


def _equal_blocks(points: DataFrame, x: list[str], total: int, block_rows: int) -> DataFrame:
    """Number the points by blocks of about ``block_rows``: equal slabs of the first coordinate, each cut into equal slabs of
    the second, and so on. A coordinate gets slabs in proportion to its spread, so blocks are about as wide as high, and
    a point's surroundings touch few of them."""
    out = points.withColumn("block", F.lit(0).cast("bigint"))
    size = total
    for name, cuts in _cuts(points, x, total / block_rows):
        pieces = min(cuts, ceil(size / block_rows))
        if pieces <= 1:
            continue
        size //= pieces  # the last slab of each also takes what is left over, so none is short
        out = ranked(out, [name, "pid"], ["block"], "_r")
        slab = F.least(F.floor((F.col("_r") - 1) / size), F.lit(pieces - 1))
        out = out.withColumn("block", F.col("block") * pieces + slab).drop("_r")
    return out


def _cuts(points: DataFrame, x: list[str], wanted: float) -> list[tuple[str, int]]:
    """Slabs of each coordinate, that of the least spread first, whose product is about ``wanted``.

    The spread is the range of the middle nine tenths, so a few far points do not decide.
    """
    if wanted <= 1:
        return []
    ends = points.agg(*[F.percentile_approx(n, [0.05, 0.95], 1000).alias(n) for n in x]).first()
    spread = {n: ends[n][1] - ends[n][0] for n in x}
    out = []
    for i, name in enumerate(sorted(x, key=lambda n: spread[n])):
        rest = [spread[n] for n in sorted(x, key=lambda n: spread[n])[i:]]
        if spread[name] > 0:
            side = exp((sum(map(log, rest)) - log(wanted)) / len(rest))  # of a cube with its share of the points
            cuts = max(1, round(spread[name] / side))
        else:
            cuts = 1 if rest[-1] > 0 else ceil(wanted ** (1 / len(rest)))
        out.append((name, cuts))
        wanted = max(1.0, wanted / cuts)
    return out


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d2 = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        d2 += (a[:, i, None] - b[None, :, i]) ** 2
    return d2


def _own_radius(pdf: pd.DataFrame, x: list[str], k: int) -> pd.DataFrame:
    """Squared distance to the k-th other point of the block; infinite if there are fewer."""
    at = pdf[x].to_numpy()
    n = len(at)
    r2 = np.full(n, np.inf)
    if n > k:
        step = max(1, CHUNK // n)
        for i in range(0, n, step):  # position k of the sorted row: itself is position 0
            r2[i : i + step] = np.partition(_squared(at[i : i + step], at), k, axis=1)[:, k]
    return pdf[["pid", *x, "block"]].assign(r2=r2)


def _nearest(asking: pd.DataFrame, held: pd.DataFrame, x: list[str], k: int) -> pd.DataFrame:
    """The k nearest held points of each asking point (ties: smaller id), not itself."""
    held = held.sort_values("pid", kind="stable")
    a, h = asking[x].to_numpy(), held[x].to_numpy()
    a_id, h_id = asking["pid"].to_numpy(), held["pid"].to_numpy()
    src, dst, dist = [], [], []
    step = max(1, CHUNK // max(1, len(h)))
    for i in range(0, len(a), step):
        d2 = _squared(a[i : i + step], h)
        d2[a_id[i : i + step, None] == h_id[None, :]] = np.inf
        worst = np.partition(d2, k - 1, axis=1)[:, k - 1] if len(h) > k else np.full(len(d2), np.inf)
        row, col = np.nonzero((d2 <= worst[:, None]) & np.isfinite(d2))  # every tie at the k-th place
        value = d2[row, col]
        order = np.lexsort((value, row))  # stable: equal distances stay in id order
        row, col, value = row[order], col[order], value[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        src.append(a_id[i : i + step][row[keep]])
        dst.append(h_id[col[keep]])
        dist.append(value[keep])
    if not src:
        return pd.DataFrame({"src": [], "dst": [], "d2": []})
    return pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst), "d2": np.concatenate(dist)})
