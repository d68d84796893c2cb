"""Expressions that treat a missing value as a value of its own.

SQL drops nulls from ``count(distinct)``, ``min`` and ``max`` and sends a null
condition to the ELSE branch. The analyses in this library need the other
convention, so every deviation from plain SQL is spelled out here once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def n_distinct(column: str) -> Column:
    """Distinct values, with all nulls together counting as one value."""
    has_null = F.max(F.col(column).isNull().cast("bigint"))
    return F.count_distinct(column) + F.coalesce(has_null, F.lit(0))


def strict_min(column: str) -> Column:
    """Minimum that is null as soon as one input is null."""
    return F.when(F.count(column) == F.count(F.lit(1)), F.min(column))


def strict_max(column: str) -> Column:
    """Maximum that is null as soon as one input is null."""
    return F.when(F.count(column) == F.count(F.lit(1)), F.max(column))


def choose(condition: Column, if_true: Column, if_false: Column) -> Column:
    """Two-way choice whose result is null when the condition is null."""
    return F.when(condition, if_true).when(~condition, if_false)


def tokens_to_null(df: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Null every string that equals one of ``tokens``, in one projection."""
    return df.select(
        *(
            F.when(~F.col(name).isin(*tokens), F.col(name)).alias(name)
            if kind == "string"
            else F.col(name)
            for name, kind in df.dtypes
        )
    )
