"""Splitting off rows that cannot be featurised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecgrid.functions.smiles import as_column, is_lexical


def invalid_reason(col: str | Column) -> Column:
    """Why a SMILES string is rejected; NULL for a good one."""
    text = as_column(col)
    return (
        F.when(text.isNull(), F.lit("missing"))
        .when(F.trim(text) == "", F.lit("empty"))
        .when(~is_lexical(text), F.lit("not lexically valid"))
    )


def flag_invalid(df: DataFrame, col: str, reason: str = "error") -> DataFrame:
    return df.withColumn(reason, invalid_reason(col))


def split_valid(df: DataFrame, col: str | None = None, reason: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good rows without the reason column, rejected rows with it).

    With ``col`` the SMILES rules decide; without, an existing ``reason`` column,
    such as the one a user encoder leaves.
    """
    flagged = df if col is None else flag_invalid(df, col, reason)
    return flagged.filter(F.col(reason).isNull()).drop(reason), flagged.filter(F.col(reason).isNotNull())
