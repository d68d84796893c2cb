"""Equi-join in which a missing key matches a missing key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join on ``keys`` with null equal to null; keys appear once in the result.

    Spark plans ``<=>`` as an ordinary hash-partitioned join. No side is hinted:
    Spark broadcasts a side whose measured size is below its threshold, and AQE
    splits a partition in which one key (often the null key) piles up.
    """
    a, b = left.alias("a"), right.alias("b")
    on = reduce(
        lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys)
    )
    key_columns = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys]
    if how in ("left", "inner"):
        key_columns = [F.col(f"a.{k}") for k in keys]
    rest = [F.col(f"a.{c}") for c in left.columns if c not in keys]
    rest += [F.col(f"b.{c}") for c in right.columns if c not in keys]
    return a.join(b, on, how).select(*key_columns, *rest)
