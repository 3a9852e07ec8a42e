"""Writers for the tables the toolkit produces.

Large writes are laid out with Spark's rebalance hint: rows are grouped by the
layout key, groups above the target file size are split over several files
and small ones are merged, so a hot cell is never one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINAL_PARTITIONS = 200


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "ignore", compression: str = "snappy") -> None:
    """Parquet dataset; by default an existing one is left as it is."""
    df.write.mode(mode).option("compression", compression).parquet(path)


def append_parquet(df: DataFrame, path: str, compression: str = "snappy") -> None:
    """Add rows to a dataset without reading what is there."""
    df.write.mode("append").option("compression", compression).parquet(path)


def write_grid(
    df: DataFrame,
    path: str,
    keys: Sequence[str] = ("cluster_id_1",),
    compression: str = "snappy",
    mode: str = "errorifexists",
) -> None:
    """One folder per bin, so a later read of one bin is pruned to its folder."""
    laid_out = df.hint("rebalance", *[F.col(k) for k in keys])
    laid_out.write.mode(mode).partitionBy(*keys).option("compression", compression).parquet(path)


def write_clusters(
    df: DataFrame,
    path: str,
    cells: int,
    n: int = FINAL_PARTITIONS,
    cell: str = "cluster_id",
    compression: str = "snappy",
    mode: str = "errorifexists",
) -> None:
    """Final table: each file covers a range of cells and is sorted by cell, so
    a read of one cell skips nearly all files and row groups."""
    per_part = max(1, -(-cells // n))
    span = F.floor(F.col(cell) / F.lit(per_part))
    laid_out = df.withColumn("_span", span).hint("rebalance", n, F.col("_span")).sortWithinPartitions(cell).drop("_span")
    laid_out.write.mode(mode).option("compression", compression).parquet(path)


def write_small_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A small result, such as a percentile profile, as one JSON file."""
    df.coalesce(1).write.mode(mode).json(path)
