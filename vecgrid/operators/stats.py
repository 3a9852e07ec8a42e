"""Upper outlier fences (q3 + 1.5 * interquartile range), filter and clip."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecgrid.operators.quantiles import quantiles, valid_number
from vecgrid.operators.skew import lookup_join
from vecgrid.session import stable


def iqr_upper_fence(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), method: str = "exact") -> DataFrame:
    """``by`` columns plus ``<col>_fence``; all columns in one aggregation."""
    q = quantiles(df, cols, [0.25, 0.75], by, method)
    fences = [(F.get(c, F.lit(1)) + (F.get(c, F.lit(1)) - F.get(c, F.lit(0))) * 1.5).alias(f"{c}_fence") for c in cols]
    return q.select(*by, *fences)


def _with_fences(df: DataFrame, cols: Sequence[str], by: Sequence[str], method: str) -> DataFrame:
    fences = iqr_upper_fence(df, cols, by, method)
    if by:
        return lookup_join(df, stable(fences), list(by))
    row = fences.first()  # one number per column
    return df.withColumns({f"{c}_fence": F.lit(row[f"{c}_fence"]).cast("double") for c in cols})


def iqr_filter(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), method: str = "exact") -> DataFrame:
    """Rows at or below the fence in every column; a missing value (NULL or NaN) is no outlier."""
    cond = reduce(lambda a, b: a & b, [F.coalesce(valid_number(c) <= F.col(f"{c}_fence"), F.lit(True)) for c in cols])
    return _with_fences(df, cols, by, method).filter(cond).select(*df.columns)


def iqr_clip(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), method: str = "exact") -> DataFrame:
    """Values above the fence become the fence; no row is dropped, and missing values (NULL or NaN) stay as they are."""
    fenced = _with_fences(df, cols, by, method)
    clipped = {c: F.when(valid_number(c) > F.col(f"{c}_fence"), F.col(f"{c}_fence")).otherwise(F.col(c).cast("double")) for c in cols}
    return fenced.withColumns(clipped).select(*df.columns)


def tail_count(df: DataFrame, col: str, below: float) -> DataFrame:
    """Number of rows with ``col`` below a bound (pushed down to the scan)."""
    return df.filter(F.col(col) < below).agg(F.count("*").alias("n_rows"))
