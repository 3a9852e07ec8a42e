"""Exact nearest neighbours of wide vectors by distances to a few pivots and the triangle inequality."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecgrid.functions.columns import apply_kernel
from vecgrid.operators.neighbours import distinct_points, rows_of_points, visit
from vecgrid.operators.ranking import ranked
from vecgrid.session import stable

PIVOTS = 32
RING_ROWS = 1024  # points per ring, at least
RINGS = 128  # beyond that many rings grow instead: a point visits all of them at worst, and each visit carries its vector
RING_NUMBERS = 1 << 21  # that a ring may grow to, rows x width
SAMPLE_ROWS = 1024  # points that the pivots are chosen from; they decide on speed, never on the result
SAMPLE_NUMBERS = 1 << 20  # the same, as a bound on rows x width
CHUNK = 1 << 20  # numbers a task holds at a time
SLACK = 1e-9  # relative allowance for rounding in every bound


def knn_vectors(
    df: DataFrame, id_col: str, vec: str, k: int = 20, pivots: int = PIVOTS, ring_rows: int = RING_ROWS
) -> DataFrame:
    """Exact Euclidean neighbours of rows with a vector column: (src, dst, weight, rank), k per row, ties by id.

    1. Rows with equal vectors become one point with its k + 1 smallest ids.
    2. A point belongs to its nearest pivot. The points of a pivot are sorted by their distance to it and cut into rings of
       ``ring_rows``, or of a share of all points if that makes more than ``RINGS`` rings; a pivot that holds most points just has
       many rings.
    3. The k-th distance within its own ring, or the k-th smallest distance around a pivot plus the way there, bounds each
       point's search. It visits the rings that the bound reaches: by the plane between two pivots, the ring's distances
       to its own pivot, and the ranges of its distances to all others.
    4. The best of all visits are merged and spelled out for every row.

    A ring is found through an equi-join on (pivot, step of distance): no task and no driver holds a list of rings. On vectors without
    any structure the bounds reach everything, and an exact search must compare all pairs. What is shuffled then still grows with the points as
    long as rings may grow (``RING_NUMBERS``), and by n^2 / ring beyond.

    ``id_col`` must be unique. Vectors must have one width; rows whose vector is NULL or holds NULL, NaN or an infinite value are left out.
    """
    if pivots < 1 or ring_rows < 1:
        raise ValueError("pivots and ring_rows must be positive")
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    rows = df.filter(F.col(vec).isNotNull() & ~bad).select(
        F.col(id_col).alias("id"), F.transform(vec, lambda v: v.cast("double") + F.lit(0.0)).alias("x")
    )
    id_type = rows.schema["id"].dataType
    points = distinct_points(rows, ["x"], k)
    widths = [r.width for r in points.select(F.size("x").alias("width")).distinct().limit(2).collect()]
    if len(widths) > 1:
        raise ValueError("vectors differ in width")
    width = widths[0] if widths else 1
    ring_rows = max(ring_rows, 2 * (k + 1))

    sample = points.select("pid", "x").orderBy(F.xxhash64("x")).limit(min(SAMPLE_ROWS, max(pivots, SAMPLE_NUMBERS // max(1, width))))
    centres = _centres(sample.toPandas(), pivots, width)
    n = len(centres)
    fields = [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("dq", "plane")]
    measured = apply_kernel(points.select("pid", "x"), F.col("x"), fields, lambda: partial(_distances, centres=centres))
    own = F.array_min("dq")
    placed = measured.withColumn("pivot", (F.array_position("dq", own) - 1).cast("int")).withColumn("own", own)
    placed = stable(ranked(placed, ["own", "pid"], ["pivot"], "place"))
    sizes = {r.pivot: r.size for r in placed.groupBy("pivot").agg(F.count("*").alias("size")).collect()}  # one row per pivot
    most = max(ring_rows, RING_NUMBERS // max(1, width))
    ring_rows = min(most, max(ring_rows, -(-sum(sizes.values()) // RINGS)))
    last = _literal([max(1, sizes.get(j, 0) // ring_rows) - 1 for j in range(n)])  # the last ring takes what is left over
    placed = placed.withColumn("ring", F.least(F.floor((F.col("place") - 1) / ring_rows), F.get(last, F.col("pivot"))))

    near = {r.pivot: r.own for r in placed.filter(F.col("place") == k + 1).select("pivot", "own").collect()}
    theta = _literal([near.get(j, float("inf")) for j in range(n)])
    by_way = F.array_min(F.zip_with("dq", theta, lambda d, t: d + t))
    schema = T.StructType([*[placed.schema[c] for c in ("pid", "x", "dq", "plane", "pivot", "own", "ring")], T.StructField("r", T.DoubleType())])
    ringed = (
        placed.select("pid", "x", "dq", "plane", "pivot", "own", "ring")
        .groupBy("pivot", "ring")
        .applyInPandas(lambda p: _ring_radius(p, k), schema)
    )
    searched = stable(ringed.withColumn("r", F.least("r", by_way) * (1 + SLACK)))

    rings = searched.groupBy("pivot", "ring").agg(
        F.min("own").alias("lo"),
        F.max("own").alias("hi"),
        F.array(
            *[F.struct(F.min(F.get("dq", F.lit(j))).alias("lo"), F.max(F.get("dq", F.lit(j))).alias("hi")) for j in range(n)]
        ).alias("box"),
    )
    rings = stable(rings)
    spans = {r.pivot: r for r in rings.groupBy("pivot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n")).collect()}
    visits = stable(_reached_rings(searched, rings, n, spans))
    floats = isinstance(df.schema[vec].dataType.elementType, T.FloatType)  # visits carry numbers as wide as they came
    x = F.col("x").cast("array<float>").alias("x") if floats else F.col("x")
    near_points = visit(
        visits,
        searched.select("pid", x, "pivot", "ring"),
        ["x"], ["pivot", "ring"], k, ring_rows, id_type, _nearest,
    )
    return rows_of_points(rows, points, near_points, ["x"], k)


def _literal(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _reached_rings(searched: DataFrame, rings: DataFrame, n: int, spans: dict) -> DataFrame:
    """(pid, pivot, ring) of every ring that may hold a point within reach."""
    if not spans:
        return searched.select("pid", "pivot", "ring").limit(0)

    def ask(span: Column, j: Column) -> Column:
        d = F.get("dq", j)
        r = F.col("r") + SLACK * (F.col("r") + d)
        first, last = F.greatest(d - r, span["lo"]), F.least(d + r, span["hi"])
        steps = [F.floor((at - span["lo"]) / span["step"]).alias(name) for at, name in ((first, "first"), (last, "last"))]
        return F.when((first <= last) & (F.get("plane", j) <= r), F.struct(j.cast("int").alias("pivot"), *steps))

    table = [(s.lo, s.hi, (s.hi - s.lo) / s.n or 1.0) if (s := spans.get(j)) else (1.0, 0.0, 1.0) for j in range(n)]  # an empty range: no points
    spanned = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(step).alias("step")) for lo, hi, step in table])
    asks = F.filter(F.transform(spanned, ask), lambda a: a.isNotNull())
    asked = searched.select("pid", "dq", "r", F.explode(asks).alias("a"))
    asked = asked.select("pid", "dq", "r", "a.*").withColumn("step", F.explode(F.sequence("first", "last")))

    span = F.get(spanned, F.col("pivot"))
    low, step = span["lo"], span["step"]
    held = rings.withColumn("from", F.floor((F.col("lo") - low) / step)).withColumn("to", F.floor((F.col("hi") - low) / step))
    held = held.select("pivot", "ring", "box", "from", F.explode(F.sequence("from", "to")).alias("step"))
    apart = F.exists(
        F.zip_with("dq", "box", lambda d, b: F.greatest(d - b["hi"], b["lo"] - d) - SLACK * (F.col("r") + d) > F.col("r")), lambda b: b
    )
    met = asked.join(held, ["pivot", "step"]).filter(F.col("step") == F.greatest("first", "from"))  # a pair meets in many steps, counts in one
    return met.filter(~apart).select("pid", "pivot", "ring")


def _centres(sample: pd.DataFrame, pivots: int, width: int) -> np.ndarray:
    """Pivots: far-apart points of the sample, moved to the middle of their surroundings."""
    if sample.empty:
        return np.zeros((1, width))
    at = np.stack(sample["x"].to_numpy())
    chosen = [0]
    d = _distances_to(at, at[:1])[:, 0]
    while len(chosen) < min(pivots, len(at)) and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, _distances_to(at, at[chosen[-1:]])[:, 0])
    centres = at[chosen]
    for _ in range(5):
        nearest = _distances_to(at, centres).argmin(axis=1)
        centres = np.stack([at[nearest == j].mean(axis=0) if (nearest == j).any() else c for j, c in enumerate(centres)])
    return centres


def _distances_to(at: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((at - c) ** 2).sum(axis=1)) for c in centres], axis=1)


def _distances(vectors: pa.Array, centres: np.ndarray) -> list[pa.Array]:
    """For each vector its distances to all pivots, and to the planes halfway between its own pivot and each other one."""
    n, width = centres.shape
    between = _distances_to(centres, centres)
    at = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), width)
    dq, plane = np.empty((len(at), n)), np.empty((len(at), n))
    step = max(1, CHUNK // max(1, width))
    for i in range(0, len(at), step):
        d = dq[i : i + step] = _distances_to(at[i : i + step], centres)
        apart = between[d.argmin(axis=1)]
        with np.errstate(divide="ignore", invalid="ignore"):
            far = (d * d - d.min(axis=1, keepdims=True) ** 2) / (2 * apart)
        plane[i : i + step] = np.where(apart > 0, far, 0.0)
    offsets = pa.array(np.arange(0, n * len(at) + 1, n, dtype=np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(m.ravel())) for m in (dq, plane)]


def _rough(a: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by one matrix product, and how far off they may be."""
    aa, hh = (a * a).sum(axis=1), (h * h).sum(axis=1)
    off = SLACK * (aa.max(initial=0.0) + hh.max(initial=0.0))
    return aa[:, None] + hh[None, :] - 2 * (a @ h.T), off


def _ring_radius(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """An upper bound of the distance to the k-th other point of the ring; infinite if there are fewer."""
    at = np.stack(pdf["x"].to_numpy())
    at = at - at.mean(axis=0)
    r = np.full(len(at), np.inf)
    if len(at) > k:
        step = max(1, CHUNK // len(at))
        for i in range(0, len(at), step):  # position k of the sorted row: itself is position 0
            d2, off = _rough(at[i : i + step], at)
            r[i : i + step] = np.sqrt(np.maximum(np.partition(d2, k, axis=1)[:, k], 0.0) + off)
    return pdf.assign(r=r)


def _nearest(asking: pd.DataFrame, held: pd.DataFrame, x: list[str], k: int) -> pd.DataFrame:
    """The k nearest held points of each asking point (ties: smaller id), not itself."""
    empty = pd.DataFrame({"src": [], "dst": [], "d2": []})
    if asking.empty or held.empty:
        return empty
    held = held.sort_values("pid", kind="stable")
    a, h = (np.stack(t[x[0]].to_numpy()).astype(np.float64) for t in (asking, held))
    a_id, h_id = asking["pid"].to_numpy(), held["pid"].to_numpy()
    middle = h.mean(axis=0)
    centred = h - middle
    parts = []
    step = max(1, CHUNK // len(h))
    for i in range(0, len(a), step):
        d2, off = _rough(a[i : i + step] - middle, centred)
        d2[a_id[i : i + step, None] == h_id[None, :]] = np.inf
        worst = np.partition(d2, k - 1, axis=1)[:, k - 1] if len(h) > k else np.full(len(d2), np.inf)
        row, col = np.nonzero((d2 <= worst[:, None] + 2 * off) & np.isfinite(d2))  # the k best are among these
        value = np.empty(len(row))
        pairs = max(1, CHUNK // a.shape[1])
        for p in range(0, len(row), pairs):
            s = slice(p, p + pairs)
            value[s] = ((a[i + row[s]] - h[col[s]]) ** 2).sum(axis=1)
        order = np.lexsort((value, row))  # stable: equal distances stay in id order
        row, col, value = row[order], col[order], value[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        parts.append(pd.DataFrame({"src": a_id[i : i + step][row[keep]], "dst": h_id[col[keep]], "d2": value[keep]}))
    return pd.concat(parts) if parts else empty
