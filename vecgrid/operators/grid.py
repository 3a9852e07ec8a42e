"""Quantile binning and nested grid cells (the core of the toolkit)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecgrid.functions.columns import add_count_leading
from vecgrid.operators.quantiles import even_probs, quantiles
from vecgrid.operators.skew import lookup_join
from vecgrid.session import stable

DEFAULT_BINS = 50
LABEL_PATTERN = re.compile(r"^\d+_\d+_\d+$")


# ---------------------------------------------------------------- edges, bins


def quantile_edges(
    df: DataFrame, col: str, n_bins: int, by: Sequence[str] = (), method: str = "sketch"
) -> DataFrame:
    """``by`` columns plus ``edges``: the n_bins + 1 cut points of ``col``."""
    return quantiles(df, [col], even_probs(n_bins), by, method).withColumnRenamed(col, "edges")


def assign_bins(
    df: DataFrame, col: str, edges: Sequence[float] | Column, out: str, n_bins: int | None = None
) -> DataFrame:
    """Add ``out``: the bin number (bigint) of ``col``. Bins are [lo, hi), the last one closed.

    Below range -> 0, above range, NaN and NULL -> last bin; among equal edges
    the last one wins. ``edges`` is a list or an array column (then give
    ``n_bins``); NULL edges put the row in the last bin.
    """
    if not isinstance(edges, Column):
        n_bins = len(edges) - 1
        edges = F.array(*[F.lit(float(e)) for e in edges])
    if n_bins is None or n_bins < 1:
        raise ValueError("at least one bin is needed")
    last = F.lit(n_bins - 1)
    x = F.col("_grid_x")
    staged = df.withColumn("_grid_x", F.coalesce(F.col(col).cast("double"), F.lit(float("nan"))))
    staged = add_count_leading(staged, lambda i: F.get(edges, i) <= x, n_bins + 1, "_reached")
    bin_no = F.least(F.greatest(F.col("_reached") - 1, F.lit(0)), last)
    bin_no = F.when(edges.isNotNull(), bin_no).otherwise(last)
    return staged.withColumn(out, bin_no.cast("bigint")).drop("_grid_x", "_reached")


def bin_column(df: DataFrame, col: str, n_bins: int, out: str, method: str = "sketch") -> DataFrame:
    """One binning step over a whole table: edges of ``col``, then bin numbers."""
    edges = quantile_edges(df, col, n_bins, method=method).first()["edges"]
    if edges is None:  # no usable value at all
        edges = [float("nan")] * ((n_bins or 1) + 1)
    return assign_bins(df, col, list(edges), out)


# ---------------------------------------------------------------- hierarchy


GRID_SCHEMA = "kind int, level int, col string, bins int, prefix string, edges array<double>, parent bigint"


@dataclass(frozen=True)
class GridModel:
    """Frozen edges of a nested grid: level l has one edge list per parent cell.

    ``first`` is the single edge list of level 1; ``tables`` hold
    (``_parent``, ``edges``) for the deeper levels.
    """

    levels: tuple[tuple[str, int], ...]
    prefix: str
    first: tuple[float, ...]
    tables: tuple[DataFrame, ...]

    @property
    def sizes(self) -> list[int]:
        return [n for _, n in self.levels]

    @property
    def bin_columns(self) -> list[str]:
        return [f"{self.prefix}{i + 1}" for i in range(len(self.levels))]


def _checked(levels: Sequence[tuple[str, int]]) -> tuple[tuple[str, int], ...]:
    levels = tuple((c, int(n)) for c, n in levels)
    if not levels or any(n < 1 for _, n in levels):
        raise ValueError("every level needs a positive number of bins")
    return levels


def _add_level(df: DataFrame, model: GridModel, level: int) -> DataFrame:
    col, n = model.levels[level]
    names = model.bin_columns
    if level == 0:
        return assign_bins(df, col, list(model.first), names[0])
    parent = encode_cell(names[:level], model.sizes[:level])
    table = model.tables[level - 1].select(F.col("_parent").alias("_grid_parent"), F.col("edges").alias("_grid_edges"))
    out = lookup_join(df.withColumn("_grid_parent", parent), table, ["_grid_parent"])
    return assign_bins(out, col, F.col("_grid_edges"), names[level], n).drop("_grid_parent", "_grid_edges")


def fit_grid(
    df: DataFrame, levels: Sequence[tuple[str, int]], method: str = "sketch", prefix: str = "cluster_id_"
) -> GridModel:
    """Edges of every level: one grouped aggregation per level.

    Each level's edges are checkpointed, so later levels and the final
    assignment all use the same numbers even where the method is randomised.
    """
    levels = _checked(levels)
    # The levels' numbers alone are kept: whatever computes them, features and projection say, runs once.
    slim = stable(df.select(*dict.fromkeys(c for c, _ in levels)))
    col, n = levels[0]
    first = quantile_edges(slim, col, n, method=method).first()["edges"]
    model = GridModel(levels, prefix, tuple(first or [float("nan")] * (n + 1)), ())
    binned = _add_level(slim, model, 0)
    for level in range(1, len(levels)):
        col, n = levels[level]
        parent = encode_cell(model.bin_columns[:level], model.sizes[:level])
        edges = quantile_edges(binned.withColumn("_parent", parent), col, n, ["_parent"], method)
        model = GridModel(levels, prefix, model.first, (*model.tables, stable(edges)))
        if level + 1 < len(levels):
            binned = _add_level(binned, model, level)
    return model


def apply_grid(df: DataFrame, model: GridModel) -> DataFrame:
    """Add one bin column per level, from frozen edges. Never drops a row."""
    for level in range(len(model.levels)):
        df = _add_level(df, model, level)
    return df


def hierarchical_bins(
    df: DataFrame, levels: Sequence[tuple[str, int]], method: str = "sketch", prefix: str = "cluster_id_"
) -> DataFrame:
    """Nested bins: level 1 over all rows, level 2 within each bin of level 1, ..."""
    return apply_grid(df, fit_grid(df, levels, method, prefix))


def save_grid(spark: SparkSession, model: GridModel, path: str, mode: str = "errorifexists") -> None:
    """Write the edges of all levels to folder ``path``, one row per level and parent cell."""
    head = [(0, i, c, n, model.prefix, list(model.first) if i == 0 else None, None) for i, (c, n) in enumerate(model.levels)]
    rows = spark.createDataFrame(head, GRID_SCHEMA)
    for level, table in enumerate(model.tables, start=1):
        fields = [F.lit(1), F.lit(level), F.lit(None), F.lit(None), F.lit(None), F.col("edges"), F.col("_parent").cast("bigint")]
        rows = rows.unionByName(table.select(*[f.alias(n) for f, n in zip(fields, rows.columns, strict=True)]))
    rows.write.mode(mode).parquet(path)


def load_grid(spark: SparkSession, path: str) -> GridModel:
    """Read a saved grid; its deeper edges stay a table of that folder."""
    rows = spark.read.schema(GRID_SCHEMA).parquet(path)
    head = rows.filter("kind = 0").orderBy("level").collect()  # one row per level
    if not head:
        raise ValueError(f"no grid at {path}")
    tables = [
        rows.filter((F.col("kind") == 1) & (F.col("level") == level)).select(F.col("parent").alias("_parent"), "edges")
        for level in range(1, len(head))
    ]
    return GridModel(tuple((r["col"], r["bins"]) for r in head), head[0]["prefix"], tuple(head[0]["edges"]), tuple(tables))


# ---------------------------------------------------------------- cell ids


def encode_cell(bins: Sequence[str | Column], sizes: Sequence[int]) -> Column:
    """Mixed-radix cell id of the bin columns (bigint)."""
    if len(bins) != len(sizes):
        raise ValueError("one size per bin column is needed")
    cols = [F.col(b) if isinstance(b, str) else b for b in bins]
    out = cols[0].cast("bigint")
    for col, size in zip(cols[1:], sizes[1:], strict=True):
        out = out * F.lit(int(size)) + col.cast("bigint")
    return out


def decode_cell(cell: str | Column, sizes: Sequence[int]) -> list[Column]:
    """Bin numbers of a cell id: the inverse of ``encode_cell``."""
    rest = (F.col(cell) if isinstance(cell, str) else cell).cast("bigint")
    out: list[Column] = []
    for size in reversed(sizes[1:]):
        digit = F.pmod(rest, F.lit(int(size)))
        out.insert(0, digit.cast("bigint"))
        rest = ((rest - digit) / F.lit(int(size))).cast("bigint")
    return [rest, *out]


def cell_label(bins: Sequence[str | Column]) -> Column:
    """Text label ``c1_c2_c3``."""
    return F.concat_ws("_", *[(F.col(b) if isinstance(b, str) else b).cast("string") for b in bins])


def is_label(label: str | Column) -> Column:
    return (F.col(label) if isinstance(label, str) else label).rlike(LABEL_PATTERN.pattern)


def parse_label(label: str | Column, parts: int = 3) -> list[Column]:
    """Bin numbers of a label column, NULL where the label is malformed."""
    col = F.col(label) if isinstance(label, str) else label
    pieces = F.split(col, "_")
    good = col.rlike(r"^\d+(_\d+){%d}$" % (parts - 1))
    return [F.when(good, F.get(pieces, F.lit(i))).try_cast("bigint") for i in range(parts)]


def select_cell(df: DataFrame, label: str, sizes: Sequence[int] | None = None, prefix: str = "cluster_id_") -> DataFrame:
    """Rows of the cell named by ``label``.

    Filters on the level columns that exist, so a dataset partitioned by them
    is pruned to one folder; otherwise on ``cluster_id`` (text or number).
    """
    if not LABEL_PATTERN.match(label):
        raise ValueError(f"cell label {label!r} is not of the form int_int_int")
    parts = [int(p) for p in label.split("_")]
    if sizes is not None and any(p >= n for p, n in zip(parts, sizes, strict=True)):
        raise ValueError(f"cell label {label!r} is outside of a grid of {tuple(sizes)}")
    names = [f"{prefix}{i + 1}" for i in range(3)]
    present = [(n, p) for n, p in zip(names, parts, strict=True) if n in df.columns]
    cond = reduce(lambda a, b: a & b, [F.col(n) == p for n, p in present], F.lit(True))
    if len(present) == 3:
        return df.filter(cond)
    if "cluster_id" not in df.columns:
        raise ValueError(f"no cell columns among {df.columns}")
    if dict(df.dtypes)["cluster_id"] == "string":
        return df.filter(cond & (F.col("cluster_id") == label))
    if sizes is None:
        raise ValueError("sizes are needed to look a label up by numeric cluster_id")
    number = (parts[0] * sizes[1] + parts[1]) * sizes[2] + parts[2]
    return df.filter(cond & (F.col("cluster_id") == number))


def cell_counts(df: DataFrame, cell: str | Sequence[str] = "cluster_id") -> DataFrame:
    return df.groupBy(*([cell] if isinstance(cell, str) else cell)).agg(F.count("*").alias("n_rows"))


def create_clusters(
    df: DataFrame,
    coords: Sequence[str] = ("PCA_1", "PCA_2", "PCA_3"),
    sizes: Sequence[int] = (DEFAULT_BINS,) * 3,
    path: str | None = None,
    method: str = "sketch",
    keep_parts: bool = False,
) -> DataFrame:
    """Whole cluster job: nested bins, one ``cluster_id``, optional final write."""
    model = fit_grid(df, list(zip(coords, sizes, strict=True)), method)
    out = apply_grid(df, model).withColumn("cluster_id", encode_cell(model.bin_columns, model.sizes))
    if not keep_parts:
        out = out.drop(*model.bin_columns)
    if path is not None:
        from vecgrid.sinks.writers import write_clusters

        write_clusters(out, path, cells=prod(model.sizes))
        out = df.sparkSession.read.parquet(path)
    return out


# ---------------------------------------------------------------- representatives


def representatives(df: DataFrame, coords: Sequence[str], cell: str, id_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """The row of each cell nearest to the cell's centroid (ties: smallest id).

    Two aggregations with map-side combine; centroids are checkpointed because
    a floating-point mean may differ in the last bit when recomputed. Rows
    lacking a coordinate are never chosen.
    """
    usable = reduce(lambda a, b: a & b, [valid(c) for c in coords])
    rows = df.filter(usable)
    centre = [f"_c{i}" for i in range(len(coords))]
    centroids = stable(
        rows.groupBy(cell).agg(*[F.avg(c).alias(n) for c, n in zip(coords, centre, strict=True)])
    )
    payload = [c for c in dict.fromkeys([*coords, *keep]) if c not in (cell, id_col)]
    slim = rows.select(cell, id_col, *payload)
    near = lookup_join(slim, centroids, [cell])
    dist2 = reduce(
        lambda a, b: a + b, [F.pow(F.col(c) - F.col(n), 2.0) for c, n in zip(coords, centre, strict=True)]
    )
    best = F.min(F.struct(dist2.alias("dist2"), F.col(id_col), *[F.col(p) for p in payload])).alias("_b")
    return near.groupBy(cell).agg(best).select(
        cell, f"_b.{id_col}", F.sqrt("_b.dist2").alias("centroid_distance"), *[f"_b.{p}" for p in payload]
    )


def valid(col: str) -> Column:
    return F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))
