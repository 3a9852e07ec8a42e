"""Joins against one-row-per-key tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join in which a NULL key matches a NULL key; columns as in ``left`` plus the rest of ``right``."""
    renamed = right.select(
        *[F.col(c).alias(f"_rhs_{c}") for c in on], *[c for c in right.columns if c not in on]
    )
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_rhs_{c}")) for c in on])
    return left.join(renamed, cond, how).drop(*[f"_rhs_{c}" for c in on])


def lookup_join(rows: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join ``rows`` with ``table`` (at most one row per ``on`` key).

    An ordinary join: adaptive execution broadcasts the table if its measured size allows that and splits hot
    keys otherwise. Works on streams against a fixed table, too.
    """
    on = list(on)
    columns = [*rows.columns, *(c for c in table.columns if c not in on)]
    return rows.join(table, on, "left").select(*columns)


def merge_lookup(rows: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """``lookup_join`` for a ``table`` that has a row for each node or point: a merge join, which hot keys may split.

    A broadcast of such a table would pass through the driver, and compressed shuffle sizes make large ones look small.
    """
    return lookup_join(rows, table.hint("merge"), on)
