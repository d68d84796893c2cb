"""The numbers a bar chart shows, computed on aggregated frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# Fixed value: charts of days-to-open stop below two weeks.
MAX_DAYS = 14


def bars(df: DataFrame, x: str, y: str, fill: str | None = None) -> DataFrame:
    """Bar heights of a frame with one row per x (and fill)."""
    return df.select(*([x, fill] if fill else [x]), y)


def stacked_bars(df: DataFrame, x: str, y: str) -> DataFrame:
    """Bar heights where several rows have the same x: they stack, so y is summed."""
    return df.groupBy(x).agg(F.sum(y).alias(y))


def filled_bars(df: DataFrame, x: str, y: str, fill: str) -> DataFrame:
    """Bars stretched to height 1: y as a share within x; one row per x and fill."""
    height = F.sum(y).over(Window.partitionBy(x))
    return bars(df, x, y, fill).withColumn("SHARE", F.try_divide(F.col(y), height))


def short_delays(days: DataFrame) -> DataFrame:
    """The part of a days-to-open frame that is drawn."""
    return days.where(F.col("AVG_DAYS_TO_OPEN") < MAX_DAYS)
