"""How long customers take to buy again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from clientela.functions.missing import strict_max
from clientela.functions.shares import with_running_share

# Fixed value: the share of customers the repurchase interval has to cover.
RETURNING_SHARE = 0.9


def repurchase_gaps(ticket: DataFrame) -> DataFrame:
    """Days between consecutive purchase days of a customer, without zeros.

    Tickets of one day give a zero gap, which is not wanted, so days are made
    distinct first. That also bounds the ordered window: a customer has at most
    as many rows as there are days in the data, however many tickets.
    """
    known = F.col("ID_CLI").isNotNull() & F.col("TIC_DATE").isNotNull()
    days = ticket.where(known).select("ID_CLI", "TIC_DATE").distinct()
    previous = F.lag("TIC_DATE").over(Window.partitionBy("ID_CLI").orderBy("TIC_DATE"))
    return days.select(
        "ID_CLI", "TIC_DATE", F.date_diff("TIC_DATE", previous).alias("diff")
    ).where(F.col("diff").isNotNull())


def longest_gaps(gaps: DataFrame) -> DataFrame:
    """Longest gap per customer."""
    return gaps.groupBy("ID_CLI").agg(strict_max("diff").alias("Max"))


def gap_histogram(longest: DataFrame) -> DataFrame:
    """Customers per longest gap. Gaps are days, so there are few rows."""
    return longest.groupBy("Max").agg(F.count(F.lit(1)).alias("n"))


def gap_quantile(longest: DataFrame, prob: float = RETURNING_SHARE) -> DataFrame:
    """Exact quantile of the longest gaps, from their histogram, in one row."""
    return gap_histogram(longest).agg(
        F.percentile("Max", F.lit(prob), F.col("n")).alias("DAYS"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("CUSTOMERS"),
    )


def gap_distribution(longest: DataFrame) -> DataFrame:
    """Share of customers whose longest gap is at most so many days."""
    return with_running_share(gap_histogram(longest), "n", [F.asc("Max")], "SHARE")
