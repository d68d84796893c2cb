"""Recency, frequency and monetary value of customers.

The definitions are this library's own: recency is days from a customer's last
purchase to the last day in the data, frequency the number of tickets, monetary
the sum spent. Scores run from 1 (worst) to 5 (best) by quintile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clientela.functions.quantiles import exact_quantiles
from clientela.sources.scratch import stored

MEASURES = ("RECENCY", "FREQUENCY", "MONETARY")
QUINTILES = (0.2, 0.4, 0.6, 0.8)


def money(column: str) -> Column:
    """Exact cents, so that sums do not depend on the order of rows."""
    return F.col(column).cast("decimal(18,2)")


def last_day(ticket: DataFrame) -> Column:
    """Last purchase day in the data, as a scalar."""
    return ticket.agg(F.max("TIC_DATE")).scalar()


def purchase_history(ticket: DataFrame, until: Column) -> DataFrame:
    """Per customer: recency at ``until``, tickets and money up to then.

    Tickets after ``until`` are not counted but reported by ``BOUGHT_AFTER``.
    Tickets without a customer belong to nobody and are left out.
    """
    counted = F.col("TIC_DATE") <= until
    return (
        ticket.where(F.col("ID_CLI").isNotNull() & F.col("TIC_DATE").isNotNull())
        .groupBy("ID_CLI")
        .agg(
            F.max(F.when(counted, F.col("TIC_DATE"))).alias("LAST_DATE"),
            F.count_distinct(F.when(counted, F.col("ID_TICKET"))).alias("FREQUENCY"),
            F.sum(F.when(counted, money("AMOUNT"))).cast("double").alias("MONETARY"),
            F.bool_or(~counted).alias("BOUGHT_AFTER"),
        )
        .where(F.col("LAST_DATE").isNotNull())
        .withColumn("RECENCY", F.date_diff(until, "LAST_DATE"))
    )


def rfm_base(ticket: DataFrame) -> DataFrame:
    return purchase_history(ticket, last_day(ticket)).select("ID_CLI", "LAST_DATE", *MEASURES)


Limits = dict[str, list[float | None]]


def rfm_limits(base: DataFrame) -> Limits:
    """The 4 exact quintile limits of the 3 measures, found at once: store ``base``."""
    found = exact_quantiles(base, {m: F.col(m) for m in MEASURES}, QUINTILES)
    return {m: found[m].quantiles for m in MEASURES}


def with_scores(base: DataFrame, limits: Limits) -> DataFrame:
    """``base`` with R_SCORE, F_SCORE and M_SCORE; a recent purchase scores high.

    A ranking window over all customers would run in a single task; comparing
    with twelve numbers needs no shuffle.
    """

    def above(measure: str) -> Column:
        passed = [(F.col(measure) > F.lit(limit)).cast("int") for limit in limits[measure]]
        return sum(passed[1:], passed[0])

    return base.withColumns(
        {
            "R_SCORE": F.lit(5) - above("RECENCY"),
            "F_SCORE": F.lit(1) + above("FREQUENCY"),
            "M_SCORE": F.lit(1) + above("MONETARY"),
        }
    )


def rfm_scores(ticket: DataFrame) -> DataFrame:
    """Customers with their measures and scores; the measures are stored."""
    base = stored(rfm_base(ticket).drop("LAST_DATE"))
    return with_scores(base, rfm_limits(base))


def segment() -> Column:
    """Name of a customer's segment; the first rule that holds decides."""
    r, f, m = F.col("R_SCORE"), F.col("F_SCORE"), F.col("M_SCORE")
    return (
        F.when((r >= 4) & (f >= 4) & (m >= 4), "champions")
        .when((r <= 2) & (f >= 4) & (m >= 4), "at risk")
        .when(f >= 4, "loyal")
        .when(m >= 4, "big spenders")
        .when((r >= 4) & (f <= 2), "new or rare")
        .when((r <= 2) & (f <= 2), "lost")
        .otherwise("regular")
    )


def rfm_segments(scores: DataFrame) -> DataFrame:
    """Customers and money per segment, with their shares of the total."""
    sums = (
        scores.withColumn("SEGMENT", segment())
        .groupBy("SEGMENT")
        .agg(F.count(F.lit(1)).alias("CUSTOMERS"), F.sum(money("MONETARY")).alias("SPENT"))
    )
    totals = sums.agg(F.struct(F.sum("CUSTOMERS").alias("n"), F.sum("SPENT").alias("spent")))
    return sums.withColumn("total", totals.scalar()).select(
        "SEGMENT",
        "CUSTOMERS",
        F.col("SPENT").cast("double").alias("SPENT"),
        F.try_divide("CUSTOMERS", "total.n").alias("CUSTOMER_SHARE"),
        F.try_divide(
            F.col("SPENT").cast("double"), F.col("total.spent").cast("double")
        ).alias("SPENT_SHARE"),
    )
