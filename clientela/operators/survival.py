"""Days until customers come back, counting those who have not come back yet.

The longest completed gap of ``intervals`` says nothing about a customer who
bought once. Here every purchase day starts a clock, which the customer's next
purchase day stops; at the last day of the data the running clocks are only known
to have run so long. The product-limit estimate uses both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from clientela.operators.intervals import RETURNING_SHARE
from clientela.operators.rfm import last_day

# Places of a survival share, which is a product of one factor per day.
DECIMALS = 9


def purchase_clocks(ticket: DataFrame) -> DataFrame:
    """Customers' clocks: ID_CLI, DAYS, and RETURNED, whether a purchase stopped it.

    Purchase days are made distinct first, so a window holds at most one row per
    calendar day, however many tickets a customer has. Rows without a customer or
    a day are left out.
    """
    days = ticket.where(F.col("ID_CLI").isNotNull() & F.col("TIC_DATE").isNotNull())
    days = days.select("ID_CLI", "TIC_DATE").distinct()
    following = F.lead("TIC_DATE").over(Window.partitionBy("ID_CLI").orderBy("TIC_DATE"))
    clocks = days.withColumn("next", following)
    return clocks.select(
        "ID_CLI",
        F.date_diff(F.coalesce("next", last_day(ticket)), "TIC_DATE").alias("DAYS"),
        F.col("next").isNotNull().alias("RETURNED"),
    )


def survival(clocks: DataFrame) -> DataFrame:
    """Per day on which a clock ends: AT_RISK, RETURNED, CENSORED, SURVIVAL.

    AT_RISK are the clocks that ran at least so long, SURVIVAL the share of
    customers who have not come back by then: the product over the days so far of
    1 - RETURNED / AT_RISK. There are as many rows as calendar days at most, so
    the ordered windows see few rows; the clocks are counted in the tasks.
    """
    ends = clocks.groupBy("DAYS").agg(
        F.count_if("RETURNED").alias("RETURNED"), F.count_if(~F.col("RETURNED")).alias("CENSORED")
    )
    later = Window.orderBy("DAYS").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    so_far = Window.orderBy("DAYS").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_risk = ends.withColumn("AT_RISK", F.sum(F.col("RETURNED") + F.col("CENSORED")).over(later))
    stays = F.lit(1.0) - F.col("RETURNED") / F.col("AT_RISK")
    return at_risk.select(
        "DAYS", "AT_RISK", "RETURNED", "CENSORED",
        F.round(F.product(stays).over(so_far), DECIMALS).alias("SURVIVAL"),
    )


def returning_day(survival: DataFrame, share: float = RETURNING_SHARE) -> DataFrame:
    """First day by which ``share`` of the customers have come back, in one row.

    DAYS is null if they never do; LAST_SURVIVAL is what is left in the end.
    """
    reached = F.col("SURVIVAL") <= F.lit(round(1 - share, DECIMALS))
    return survival.agg(
        F.min(F.when(reached, F.col("DAYS"))).alias("DAYS"),
        F.min("SURVIVAL").alias("LAST_SURVIVAL"),
        F.coalesce(F.sum(F.col("RETURNED") + F.col("CENSORED")), F.lit(0)).alias("CLOCKS"),
    )
