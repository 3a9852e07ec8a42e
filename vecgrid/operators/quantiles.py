"""Quantiles of columns, overall or per group, by four interchangeable methods.

``exact``   linear interpolation, same numbers as numpy. Values are sorted across the
            cluster, so no group has to fit a task. ``exact_gather`` sorts each group
            in one task instead: an explicit choice for groups known to be small.
``sketch``  KLL sketches: one pass, tiny shuffle, rank error about 1.3/k.
``approx``  ``percentile_approx``.

NULL and NaN values never count towards a quantile.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecgrid.operators.ranking import running_total
from vecgrid.operators.skew import null_safe_join

KLL_K = 4000
APPROX_ACCURACY = 100_000

METHODS = ("exact", "exact_gather", "sketch", "approx")


def valid_number(col: str | Column) -> Column:
    """The value as double, NULL for NULL and NaN."""
    x = (F.col(col) if isinstance(col, str) else col).cast("double")
    return F.when(~F.isnan(x), x)


def even_probs(n_bins: int) -> list[float]:
    """Grid 0, 1/n, ..., 1; just [0, 1] for ``n_bins == 0``."""
    if n_bins < 0:
        raise ValueError("n_bins must not be negative")
    n = n_bins or 1
    return [i / n for i in range(n + 1)]


def quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    method: str = "sketch",
) -> DataFrame:
    """One row per group (one row in all without ``by``): the group columns and,
    for every column, an array with one value per probability.
    """
    if method not in METHODS:
        raise ValueError(f"unknown quantile method {method!r}, use one of {METHODS}")
    by, cols, probs = list(by), list(cols), [float(p) for p in probs]
    if method == "exact":
        per_col = [_sorted_quantiles(df, c, probs, by) for c in cols]
        return reduce(lambda a, b: _join_groups(a, b, by), per_col)

    wanted = F.array(*[F.lit(p) for p in probs])
    slim = df.select(*by, *[valid_number(c).alias(c) for c in cols])
    if method == "exact_gather":
        aggs = [F.sort_array(F.collect_list(c)).alias(c) for c in cols]
    elif method == "approx":
        aggs = [F.percentile_approx(c, wanted, F.lit(APPROX_ACCURACY)).alias(c) for c in cols]
    else:
        aggs = [F.kll_sketch_agg_double(c, F.lit(KLL_K)).alias(c) for c in cols]
    out = slim.groupBy(*by).agg(*aggs)
    if method == "sketch":
        out = out.select(*by, *[sketch_values(c, probs).alias(c) for c in cols])
    if method == "exact_gather":
        out = out.select(*by, *[_interpolated(F.col(c), wanted).alias(c) for c in cols])
    return out


def _interpolated(values: Column, probs: Column) -> Column:
    """Quantiles of a sorted array of values; NULL for an empty one."""

    def at(p: Column) -> Column:
        pos = (F.size(values) - 1) * p
        low, high = F.get(values, F.floor(pos).cast("int")), F.get(values, F.ceil(pos).cast("int"))
        return _between(low, high, pos - F.floor(pos))

    return F.when(F.size(values) > 0, F.transform(probs, at))


def _between(low: Column, high: Column, share: Column) -> Column:
    """Exactly the value itself between equal neighbours, or bins would shift by a rounding error."""
    return F.when((share == 0) | (low == high), low).otherwise(low + (high - low) * share)


def sketch_values(sketch: str | Column, probs: Sequence[float]) -> Column:
    """Quantiles held by a KLL sketch column; NULL for an empty sketch."""
    sk = F.col(sketch) if isinstance(sketch, str) else sketch
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    return F.when(F.kll_sketch_get_n_double(sk) > 0, F.kll_sketch_get_quantile_double(sk, wanted))


def _join_groups(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    if not by:  # one row each
        one = F.lit(1).alias("_one")
        return left.select("*", one).join(right.select("*", one), "_one").drop("_one")
    return null_safe_join(left, right, by)


def _sorted_quantiles(df: DataFrame, col: str, probs: list[float], by: list[str]) -> DataFrame:
    """Exact interpolated quantiles by one distributed sort of distinct values.

    Equal values are counted before the sort, so a hot value is one row; a hot
    group is spread over tasks by value. Only the rows that hold a wanted
    position (at most two per probability and group) are gathered.
    """
    value = valid_number(col)
    counted = df.select(*by, value.alias("_v")).groupBy(*by, "_v").agg(
        F.count("_v").alias("_n")  # 0 for the NULL row, which keeps empty groups visible
    )
    cum = running_total(counted, ["_v"], "_n", by, "_end", "_size")

    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(probs)])
    pos = (F.col("_size") - 1) * F.col("_w.p")
    start = F.col("_end") - F.col("_n")
    holds = lambda at: (at >= start) & (at < F.col("_end"))
    hits = (
        cum.filter((F.col("_n") > 0) & _near_position(probs))
        .select(*by, "_v", "_n", "_end", "_size", F.explode(wanted).alias("_w"))
        .withColumn("_pos", pos)
        .withColumn("_low", F.when(holds(F.floor("_pos")), F.col("_v")))
        .withColumn("_high", F.when(holds(F.ceil("_pos")), F.col("_v")))
        .filter(F.col("_low").isNotNull() | F.col("_high").isNotNull())
    )
    share = F.first("_pos") - F.floor(F.first("_pos"))
    points = hits.groupBy(*by, F.col("_w.i").alias("_i")).agg(
        _between(F.max("_low"), F.max("_high"), share).alias("_q")
    )
    gathered = points.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda s: s["_q"]).alias(col)
    )
    if not by:
        return gathered.select(F.when(F.size(col) > 0, F.col(col)).alias(col))
    return _join_groups(counted.select(*by).distinct(), gathered, by)


def _near_position(probs: list[float]) -> Column:
    """False for most rows that hold no wanted position, true for all that do.

    If all probabilities are multiples of 1/m, a row can be told to lie between two
    neighbouring positions by plain arithmetic, however many there are.
    """
    m = next((m for m in range(1, 10_001) if all(abs(p * m - round(p * m)) < 1e-9 for p in probs)), None)
    if m is None:
        return F.lit(True)
    last = F.col("_size") - 1
    first, after = F.col("_end") - F.col("_n") - 1, F.col("_end")
    crossed = F.floor(after * m / last + 1e-6) >= F.ceil(first * m / last - 1e-6)
    return F.when(last > 0, crossed).otherwise(True)
