"""Incremental forms of the batch operators (Structured Streaming, file sources).

Stateless work (project, assign) goes straight to a parquet sink. What a batch job
would aggregate (moments, sketches) is written as one partial result per
micro-batch, in a folder named by batch id: a repeated batch overwrites its own
folder, and readers merge all folders. Nothing is read-modify-written.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecgrid.operators import reduce as red
from vecgrid.operators import sketches
from vecgrid.operators.grid import GridModel, apply_grid, encode_cell


def file_stream(
    spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int | None = None, **options
) -> DataFrame:
    """Stream of the files that arrive under ``path``."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def _sink(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def project_stream(
    stream: DataFrame,
    model: red.PCAModel,
    path: str,
    checkpoint: str,
    vec: str = "fp",
    featurize: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Featurise (optional) and project arriving rows with a saved model."""
    rows = featurize(stream) if featurize else stream
    return _sink(red.pca_transform(rows, vec, model), path, checkpoint)


def assign_stream(stream: DataFrame, model: GridModel, path: str, checkpoint: str) -> StreamingQuery:
    """Bin arriving rows with frozen edges, add their ``cluster_id``."""
    binned = apply_grid(stream, model)
    return _sink(binned.withColumn("cluster_id", encode_cell(model.bin_columns, model.sizes)), path, checkpoint)


def _per_batch(
    stream: DataFrame, partial: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def moments_stream(stream: DataFrame, path: str, checkpoint: str, vec: str, width: int) -> StreamingQuery:
    """PCA moments of each micro-batch; ``read_moments`` merges them."""
    return _per_batch(stream, lambda b: red.moments(b, vec, width), path, checkpoint)


def read_moments(spark: SparkSession, path: str) -> DataFrame:
    return red.merge_moments(spark.read.parquet(path).drop("batch_id"))


def sketch_stream(
    stream: DataFrame, path: str, checkpoint: str, cols: Sequence[str], by: Sequence[str] = ()
) -> StreamingQuery:
    """Quantile sketches of each micro-batch; ``read_sketches`` merges them."""
    return _per_batch(stream, lambda b: sketches.build(b, cols, by), path, checkpoint)


def read_sketches(spark: SparkSession, path: str, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    stored = spark.read.parquet(path)
    return sketches.merge(stored.filter(F.col(cols[0]).isNotNull()), cols, by)
