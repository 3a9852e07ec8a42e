"""Numbered chunks of consecutive rows per source file."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecgrid.operators.ranking import ranked
from vecgrid.session import stable

BROADCAST_SPLITS = 500_000  # rows of the table of splits that is sent to every task


def source_stem(source: str | Column) -> Column:
    """File name up to its first dot."""
    source = F.col(source) if isinstance(source, str) else source
    return F.substring_index(F.substring_index(source, "/", -1), ".", 1)


def _check(chunksize: int) -> None:
    if chunksize < 1:
        raise ValueError("chunksize must be positive")


def chunk_plan(df: DataFrame, chunksize: int, source: Sequence[str] = ("_source",)) -> DataFrame:
    """Rows and chunks per source (one line in all for ``source=()``)."""
    _check(chunksize)
    counts = df.groupBy(*source).agg(F.count("*").alias("n_rows"))
    return counts.withColumn("n_chunks", F.ceil(F.col("n_rows") / F.lit(chunksize)).cast("bigint"))


def assign_chunk_id(
    df: DataFrame, chunksize: int, order_by: Sequence[str] = ("_block", "_pos"), source: Sequence[str] = ("_source",)
) -> DataFrame:
    """Add ``chunk_id``: chunks of ``chunksize`` consecutive rows, from 0 per source.

    Rows are numbered by a distributed sort, so one source holding most rows
    is no bottleneck. The default order is that of the file (see ``read_strings``).
    """
    _check(chunksize)
    numbered = ranked(df, order_by, source, "_rn")
    chunk = F.floor((F.col("_rn") - 1) / F.lit(chunksize)).cast("bigint")
    return numbered.withColumn("chunk_id", chunk).drop("_rn")


def _place_in_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the place of each row in its split, from 0. A task reads its splits one after the other, each in file order."""
    last, seen = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        source, block = b.column("_source").dictionary_encode(), b.column("_block").to_numpy()
        change = (np.diff(source.indices.to_numpy()) != 0) | (np.diff(block) != 0)
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        sizes = np.diff(np.append(starts, b.num_rows))
        place = np.arange(b.num_rows) - np.repeat(starts, sizes)
        if (source[0].as_py(), block[0]) == last:
            place[: sizes[0]] += seen
        last, seen = (source[-1].as_py(), block[-1]), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place)], names=[*b.schema.names, "_place"])


def assign_chunk_id_by_splits(df: DataFrame, chunksize: int) -> DataFrame:
    """``assign_chunk_id`` in file order for rows straight from ``read_strings(position=True)``, without a sort.

    Rows are counted once for each split of a file; the rows before a split and the place in it give the number of a row.
    The table of splits alone is shuffled and kept. Should Spark cut the files anew between the two readings, a split that
    begins at a known byte still has the same rows before it, and one that does not stops the job.
    """
    _check(chunksize)
    splits = df.groupBy("_source", "_block").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy("_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    splits = stable(splits.select("_source", "_block", before))
    if splits.count() <= BROADCAST_SPLITS:
        splits = F.broadcast(splits)
    fields = ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)
    placed = df.mapInArrow(_place_in_split, f"{fields}, _place long").join(splits, ["_source", "_block"], "left")
    known = F.when(F.col("_before").isNull(), F.raise_error(F.lit("files were cut otherwise when counted"))).otherwise(F.col("_before"))
    chunk = F.floor((known + F.col("_place")) / F.lit(chunksize)).cast("bigint")
    return placed.select(*df.columns, chunk.alias("chunk_id"))
