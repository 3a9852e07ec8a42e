"""Exact global and per-group ranks without a single-task window.

``row_number()`` over one hot group (or over no group at all) sends that group
to one task. Here the rows are range-partitioned on the whole sort key, so a
group of any size spans as many tasks as it needs; a table with one row per
(task, group) supplies the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecgrid.operators.skew import null_safe_join
from vecgrid.session import stable

_PART, _POS = "_rk_part", "_rk_pos"


def sorted_runs(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Globally sorted copy of ``df`` with task number and position columns.

    The copy is checkpointed: both columns must stay fixed for later jobs.
    """
    mono = F.monotonically_increasing_id()
    return stable(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn(_POS, mono)
        .withColumn(_PART, F.shiftright(_POS, 33))
    )


def _with_offsets(runs: DataFrame, sizes: DataFrame, by: Sequence[str], extra: Sequence[str]) -> DataFrame:
    """Attach to each run the summed size of the earlier runs of its group.

    ``sizes`` has one row per (task, group): at most tasks + groups rows, and a
    group's window holds at most one row per task.
    """
    before = Window.partitionBy(*by).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "*",
        F.coalesce(F.sum("_rk_size").over(before), F.lit(0)).alias("_rk_before"),
        F.sum("_rk_size").over(Window.partitionBy(*by)).alias("_rk_group"),
    )
    return null_safe_join(runs, offsets.select(*by, _PART, *extra, "_rk_before", "_rk_group"), [*by, _PART])


def ranked(
    df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] = (), out: str = "rank"
) -> DataFrame:
    """Add ``out``: the 1-based ``row_number`` of each row in its group.

    ``order_by`` should identify a row within its group; ties are numbered in
    an arbitrary (but then fixed) order.
    """
    by = list(partition_by)
    runs = sorted_runs(df, [*by, *order_by])
    sizes = runs.groupBy(*by, _PART).agg(
        F.count("*").alias("_rk_size"), F.min(_POS).alias("_rk_first")
    )
    placed = _with_offsets(runs, sizes, by, ["_rk_first"])
    return placed.withColumn(
        out, F.col(_POS) - F.col("_rk_first") + F.col("_rk_before") + 1
    ).select(*df.columns, out)


def running_total(
    df: DataFrame,
    order_by: Sequence[str],
    weight: str,
    partition_by: Sequence[str] = (),
    out: str = "total",
    group_out: str = "group_total",
) -> DataFrame:
    """Add ``out``, the inclusive running sum of ``weight`` in each group, and
    ``group_out``, the sum over the whole group.

    The window groups are (task, group) runs, so none exceeds one task's share.
    """
    by = list(partition_by)
    runs = sorted_runs(df, [*by, *order_by])
    within = Window.partitionBy(*by, _PART).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("_rk_within", F.sum(weight).over(within))
    sizes = runs.groupBy(*by, _PART).agg(F.sum(weight).alias("_rk_size"))
    placed = _with_offsets(runs, sizes, by, [])
    return placed.select(
        *df.columns,
        (F.col("_rk_within") + F.col("_rk_before")).alias(out),
        F.col("_rk_group").alias(group_out),
    )
