"""Shares of a total and running shares, of frames with any number of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from clientela.sources.scratch import stored


def with_share(df: DataFrame, amount: str, name: str) -> DataFrame:
    """``df`` with ``amount`` over its column total.

    The total is a scalar made of the same shuffle as ``df``, which runs once if
    ``df`` ends in an aggregation.
    """
    total = df.agg(F.sum(amount)).scalar()
    return df.withColumn(name, F.try_divide(F.col(amount), total))


def running_totals(
    df: DataFrame, amount: str, order: Sequence[Column], running: str, total: str
) -> DataFrame:
    """``df`` with the sum of ``amount`` up to each row, and over all rows.

    ``order`` must be total: equal rows are told apart, in any order. Rows are
    dealt into ranges of the order, which is stored so that both readings see the
    same ranges. Sums of the ranges, one row per range, give what lies before
    each, and within a range one task goes on from there. Ranges are as many as
    shuffle partitions at most, and fewer where there are few rows.
    """
    part = _free(df, "part")
    dealt = stored(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sums = dealt.groupBy(part).agg(F.sum(amount).alias("range_sum"))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before, after = _free(df, "before"), _free(df, total)
    offsets = sums.select(
        part,
        F.coalesce(F.sum("range_sum").over(earlier), F.lit(0)).alias(before),
        F.sum("range_sum").over(Window.partitionBy()).alias(after),
    )
    so_far = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row per shuffle partition.
    placed = dealt.join(F.broadcast(offsets), part)
    return placed.select(
        *df.columns, (F.col(before) + F.sum(amount).over(so_far)).alias(running), F.col(after).alias(total)
    )


def with_running_share(df: DataFrame, amount: str, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with the running sum of ``amount`` over its total, in a total order."""
    running, total = _free(df, "running"), _free(df, "total")
    shares = running_totals(df, amount, order, running, total)
    return shares.withColumn(name, F.try_divide(running, total)).select(*df.columns, name)


def _free(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores in front as it takes to be new in ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
