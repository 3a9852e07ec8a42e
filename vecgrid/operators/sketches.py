"""Persistable, mergeable quantile sketches (KLL) and percentile profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecgrid.operators.quantiles import KLL_K, quantiles, sketch_values, valid_number


def build(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), k: int = KLL_K) -> DataFrame:
    """``by`` columns plus one binary sketch per column: a plain table to store."""
    return df.groupBy(*by).agg(*[F.kll_sketch_agg_double(valid_number(c), F.lit(k)).alias(c) for c in cols])


def merge(sketches: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Sketches of the united data from sketches of its parts."""
    return sketches.groupBy(*by).agg(*[F.kll_merge_agg_double(c).alias(c) for c in cols])


def read_quantiles(sketches: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Replace each sketch by the array of its quantiles, with ``<col>_n`` values seen."""
    rest = [c for c in sketches.columns if c not in set(cols)]
    return sketches.select(
        *rest,
        *[sketch_values(c, probs).alias(c) for c in cols],
        *[F.kll_sketch_get_n_double(c).alias(f"{c}_n") for c in cols],
    )


def percentile_profile(df: DataFrame, col: str, step: int = 2, method: str = "sketch") -> DataFrame:
    """Long table (percentile, value) at 0, step, ... below 100."""
    percents = list(range(0, 100, step))
    row = quantiles(df, [col], [p / 100 for p in percents], method=method)
    return row.select(F.posexplode(col).alias("_i", "value")).select(
        (F.col("_i") * step).alias("percentile"), "value"
    )
