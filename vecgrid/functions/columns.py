"""Vector column <-> wide columns, and numpy views of Arrow list columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Inside a lambda a repeated sub-expression is evaluated again for every element; a
    lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_leading(tests: Sequence[Column]) -> Column:
    """Number of leading true tests where all true ones come first.

    A decision tree: log2(n) tests are evaluated per row, in plain generated code.
    """
    if not tests:
        return F.lit(0)

    def branch(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(tests[mid], branch(mid + 1, hi)).otherwise(branch(lo, mid))

    return branch(0, len(tests))


def add_count_leading(df: DataFrame, test: Callable[[Column], Column], n: int, out: str) -> DataFrame:
    """Add ``out``: how many of test(0) ... test(n - 1) hold, all true ones coming first.

    Beyond a few tests it takes two steps, first the run of tests and then the place
    within it, each a small decision tree: one tree over all tests would make a method
    too long for the JVM to compile. ``test`` must give NULL or false past the end.
    """
    if n <= 16:
        return df.withColumn(out, count_leading([test(F.lit(i)) for i in range(n)]))
    run = ceil(sqrt(n))
    runs = df.withColumn("_run", count_leading([test(F.lit(i)) for i in range(0, n, run)]))
    at = (F.col("_run") - 1) * run
    within = count_leading([test(at + j) for j in range(1, run)])
    return runs.withColumn(out, F.when(F.col("_run") > 0, at + 1 + within).otherwise(0)).drop("_run")


def widen(df: DataFrame, col: str, width: int, prefix: str = "fp_", keep: Sequence[str] | None = None) -> DataFrame:
    """Array column to ``prefix1 ... prefixN`` (1-based); missing positions are NULL."""
    keep = [c for c in df.columns if c != col] if keep is None else list(keep)
    return df.select(*keep, *[F.get(col, F.lit(i)).alias(f"{prefix}{i + 1}") for i in range(width)])


def to_vector(df: DataFrame, cols: Sequence[str], out: str = "fp", dtype: str = "double") -> DataFrame:
    """Wide columns to one array column; the other columns are kept."""
    rest = [c for c in df.columns if c not in set(cols)]
    return df.select(*rest, F.array(*[F.col(c).cast(dtype) for c in cols]).alias(out))


def matrix_of(arr: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows x width) matrix of the usable vectors and the mask of usable rows.

    A NULL vector, one of another width, or one holding NULL, NaN or an infinite value is unusable.
    """
    ok = np.asarray(arr.value_lengths().fill_null(-1)) == width
    flat = arr.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    mat = flat.reshape(-1, width)
    good = np.isfinite(mat).all(axis=1)
    if not good.all():
        mat = mat[good]
        ok = ok.copy()
        ok[np.flatnonzero(ok)[~good]] = False
    return mat, ok


def lists_of(mat: np.ndarray, ok: np.ndarray, value_type: pa.DataType) -> pa.Array:
    """Arrow list column with the rows of ``mat`` where ``ok``, NULL elsewhere."""
    width = mat.shape[1]
    sizes = np.where(ok, width, 0)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    flat = pa.array(np.ascontiguousarray(mat).reshape(-1), type=value_type)
    return pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array(~ok))


Kernel = Callable[[pa.Array], Sequence[pa.Array]]


def apply_kernel(
    df: DataFrame, arg: Column, fields: Sequence[T.StructField], make_kernel: Callable[[], Kernel], drop: Sequence[str] = ()
) -> DataFrame:
    """Add ``fields`` computed batch-wise from ``arg`` by an Arrow kernel.

    ``arg`` is evaluated in the JVM; the kernel (made once per task) gets it as an
    Arrow array and returns one array per field. All other columns pass through
    as they are. A map over batches, unlike a Python function inside an
    expression, takes any built-in expression as argument, those with lambdas included; for other arguments
    ``apply_to_argument`` is the better choice.
    """
    names = {f.name for f in fields}
    kept = [c for c in df.columns if c not in set(drop) | names]
    staged = df.select(*kept, arg.alias("_arg"))
    schema = T.StructType([*df.select(*kept).schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make_kernel()
        for batch in batches:
            added = kernel(batch.column(len(kept)))
            arrays = [*batch.columns[: len(kept)], *added]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, *[f.name for f in fields]])

    return staged.mapInArrow(run, schema)


def apply_to_argument(
    df: DataFrame, arg: Column, fields: Sequence[T.StructField], make_kernel: Callable[[], Kernel], drop: Sequence[str] = ()
) -> DataFrame:
    """As ``apply_kernel`` for an ``arg`` without lambdas: only the argument goes through Python, other columns stay in the JVM
    and can be pruned. Marked as not deterministic so that the planner never evaluates it twice."""
    names = [f.name for f in fields]
    kept = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in set(drop) | set(names)]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kernel = make_kernel()
        for batch in batches:
            yield pa.StructArray.from_arrays(list(kernel(batch)), names=names)

    added = F.arrow_udf(run, T.StructType(list(fields))).asNondeterministic()(arg)
    return df.select(*kept, added.alias("_kernel")).select(*kept, *[F.col("_kernel").getField(n).alias(n) for n in names])
