"""Mergeable moments and PCA over a vector column.

Moments are a table with one row per dimension: ``dim, n, nulls, means,
comoments`` (row ``dim`` of the centred co-moment matrix). Tables of different
batches merge in any order, so a model can grow with new data without rereading
the old.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecgrid.functions.columns import apply_to_argument, matrix_of

MAX_WIDTH = 4096  # the d x d matrix is solved on the driver: 128 MB at most
MOMENTS_SCHEMA = "dim int, n bigint, nulls bigint, means array<double>, comoments array<double>"


class _Running:
    """Count, mean and centred co-moments, merged pairwise."""

    def __init__(self, rows: int, width: int) -> None:
        self.n = 0
        self.nulls = 0
        self.mean = np.zeros(width)
        self.co = np.zeros((rows, width))

    def merge(self, n: int, nulls: int, mean: np.ndarray, co: np.ndarray, dims: slice) -> None:
        self.nulls += nulls
        if n == 0:
            return
        delta = mean - self.mean
        total = self.n + n
        self.co += co + np.outer(delta[dims], delta) * (self.n * n / total)
        self.mean += delta * (n / total)
        self.n = total


def moments(df: DataFrame, vec: str, width: int, max_partials: int | None = None) -> DataFrame:
    """Moments of the vectors of ``df`` (NULL vectors and ones with NULL/NaN are only counted).

    Each task streams its rows into one d x d matrix and emits it as d rows;
    those meet again per dimension. The number of tasks is limited, without a
    shuffle, so the emitted volume does not grow with the data.
    """
    if not 0 < width <= MAX_WIDTH:
        raise ValueError(f"vector width must be between 1 and {MAX_WIDTH}")
    partials = max_partials or 4 * df.sparkSession.sparkContext.defaultParallelism

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = _Running(width, width)
        everything = slice(None)
        for batch in batches:
            mat, ok = matrix_of(batch.column(0), width)
            n, nulls = len(mat), int((~ok).sum())
            mean = mat.mean(axis=0) if n else run.mean
            centred = mat - mean
            run.merge(n, nulls, mean, centred.T @ centred, everything)
        if run.n or run.nulls:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(width, dtype=np.int32)),
                    pa.array(np.full(width, run.n)),
                    pa.array(np.full(width, run.nulls)),
                    pa.array([run.mean] * width, pa.list_(pa.float64())),
                    pa.array(list(run.co), pa.list_(pa.float64())),
                ],
                ["dim", "n", "nulls", "means", "comoments"],
            )

    parts = df.select(F.col(vec).cast("array<double>").alias("v")).coalesce(partials)
    return merge_moments(parts.mapInArrow(accumulate, MOMENTS_SCHEMA))


def _merge_dim(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    run = None
    dim = int(key[0])
    for pdf in parts:
        for row in pdf.itertuples(index=False):
            mean = np.asarray(row.means)
            run = run or _Running(1, len(mean))
            run.merge(int(row.n), int(row.nulls), mean, np.asarray(row.comoments), slice(dim, dim + 1))
    yield pd.DataFrame(
        {"dim": [dim], "n": [run.n], "nulls": [run.nulls], "means": [run.mean], "comoments": [run.co[0]]}
    )


def merge_moments(parts: DataFrame) -> DataFrame:
    """One moments table from any number of them (union the tables first).

    A dimension's rows are streamed through a running merge, never held at once.
    """
    return parts.groupBy("dim").applyInPandas(_merge_dim, MOMENTS_SCHEMA)


def update(table: DataFrame, new: DataFrame, vec: str, width: int) -> DataFrame:
    """Moments of the old data plus the rows of ``new``."""
    return merge_moments(table.select("dim", "n", "nulls", "means", "comoments").unionByName(moments(new, vec, width)))


# ---------------------------------------------------------------- model


@dataclass(frozen=True)
class PCAModel:
    n: int
    nulls: int
    mean: np.ndarray
    components: np.ndarray  # k x d, falling variance
    explained_variance: np.ndarray
    explained_variance_ratio: np.ndarray

    @property
    def width(self) -> int:
        return len(self.mean)


def fit_from_moments(table: DataFrame, k: int = 3) -> PCAModel:
    """Exact PCA from a moments table: centred, unscaled.

    Only d rows of d numbers reach the driver. Sign rule: the largest loading (by
    magnitude) of each component is positive.
    """
    rows = sorted(table.collect(), key=lambda r: r.dim)
    if not rows or rows[0].n == 0:
        raise ValueError("no usable vectors to fit on")
    n, width = rows[0].n, len(rows)
    if not 0 < k <= width:
        raise ValueError(f"cannot take {k} components of {width} dimensions")
    cov = np.array([r.comoments for r in rows]) / max(n - 1, 1)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(values)[::-1][:k]
    components = vectors[:, order].T
    lead = components[np.arange(k), np.abs(components).argmax(axis=1)]
    components = components * np.where(lead < 0, -1.0, 1.0)[:, None]
    variance = np.clip(values[order], 0, None)
    total = float(np.trace(cov))
    ratio = variance / total if total > 0 else np.zeros(k)
    return PCAModel(n, rows[0].nulls, np.array(rows[0].means), components, variance, ratio)


def pca_fit(df: DataFrame, vec: str, width: int, k: int = 3) -> PCAModel:
    return fit_from_moments(moments(df, vec, width), k)


def pca_transform(
    df: DataFrame, vec: str, model: PCAModel, prefix: str = "PCA_", keep_vector: bool = False
) -> DataFrame:
    """Add ``PCA_1 ... PCA_k`` = (x - mean) . components; NULL for an unusable vector.

    A narrow map: one matrix product per Arrow batch, no shuffle. The other
    columns are carried along, the vector is dropped unless ``keep_vector``.
    """
    weights = np.ascontiguousarray(model.components.T)
    mean = model.mean

    def project(vectors: pa.Array) -> list[pa.Array]:
        mat, ok = matrix_of(vectors, len(mean))
        coords = np.zeros((len(ok), weights.shape[1]))
        coords[ok] = (mat - mean) @ weights
        return [pa.array(coords[:, i], mask=~ok) for i in range(weights.shape[1])]

    fields = [T.StructField(f"{prefix}{i + 1}", T.DoubleType()) for i in range(weights.shape[1])]
    arg = F.col(vec).cast("array<double>")
    return apply_to_argument(df, arg, fields, lambda: project, drop=() if keep_vector else (vec,))


def pca_summary(spark: SparkSession, model: PCAModel) -> DataFrame:
    """One row per component: variance, share of the total, rows used and skipped."""
    rows = [
        (i + 1, float(v), float(r), int(model.n), int(model.nulls))
        for i, (v, r) in enumerate(zip(model.explained_variance, model.explained_variance_ratio, strict=True))
    ]
    schema = "component int, explained_variance double, explained_variance_ratio double, n_rows bigint, n_null bigint"
    return spark.createDataFrame(rows, schema)


MODEL_SCHEMA = (
    "n bigint, nulls bigint, mean array<double>, components array<array<double>>, "
    "explained_variance array<double>, explained_variance_ratio array<double>"
)


def model_table(spark: SparkSession, model: PCAModel) -> DataFrame:
    row = (
        int(model.n),
        int(model.nulls),
        model.mean.tolist(),
        model.components.tolist(),
        model.explained_variance.tolist(),
        model.explained_variance_ratio.tolist(),
    )
    return spark.createDataFrame([row], MODEL_SCHEMA)


def save_model(spark: SparkSession, model: PCAModel, path: str, mode: str = "errorifexists") -> None:
    model_table(spark, model).coalesce(1).write.mode(mode).parquet(path)


def load_model(spark: SparkSession, path: str) -> PCAModel:
    """Read a saved model; fails at once if there is none, before any job on the data."""
    row = spark.read.schema(MODEL_SCHEMA).parquet(path).first()
    if row is None:
        raise ValueError(f"no model at {path}")
    arrays: Sequence[np.ndarray] = [
        np.array(row[c]) for c in ("mean", "components", "explained_variance", "explained_variance_ratio")
    ]
    return PCAModel(row.n, row.nulls, *arrays)
