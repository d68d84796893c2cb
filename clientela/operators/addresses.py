"""Cleaning and geography of customer addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clientela.functions.missing import choose
from clientela.functions.shares import running_totals
from clientela.operators.distributions import distinct_share

# Fixed value: the share of addresses the best provinces have to reach.
COVERAGE = 0.50


def distinct_addresses(address: DataFrame) -> DataFrame:
    """Whole-row duplicates removed, postcode as text."""
    return address.distinct().withColumn("CAP", F.col("CAP").cast("string"))


def province_without_region(address: DataFrame) -> DataFrame:
    return address.where(F.col("PRV").isNotNull() & F.col("REGION").isNull())


def complete_addresses(address: DataFrame) -> DataFrame:
    """Rows with postcode, province and region all known.

    Enough for everything that counts distinct ids: repeated rows change nothing
    there, so shuffling whole rows to remove them would be wasted.
    """
    return address.where(
        F.col("CAP").isNotNull() & F.col("PRV").isNotNull() & F.col("REGION").isNotNull()
    )


def clean_addresses(address: DataFrame) -> DataFrame:
    """Complete rows without duplicates; incomplete rows go before the shuffle."""
    return distinct_addresses(complete_addresses(address))


def province_shares(complete: DataFrame) -> DataFrame:
    return distinct_share(complete, "PRV", "ID_ADDRESS", "TOT_ID_ADDRESS")


def region_shares(complete: DataFrame) -> DataFrame:
    return distinct_share(complete, "REGION", "ID_ADDRESS", "TOT_ID_ADDRESS")


def best_provinces(shares: DataFrame) -> DataFrame:
    """Label the largest provinces that together reach the coverage, others 'others'.

    Provinces are text, so there may be any number of them. What the province
    before covers is the running sum without the own one. The label keeps two
    edge cases of the analysis it follows: a first province that is above the
    coverage on its own has no predecessor and hence a null label, and a running
    share of exactly the coverage is neither below nor above it.
    """
    order = [F.desc("PERCENT"), F.asc_nulls_last("PRV")]
    summed = running_totals(shares, "TOT_ID_ADDRESS", order, "running", "total")
    before = F.col("running") - F.col("TOT_ID_ADDRESS")
    covered = F.try_divide("running", "total")
    crosses = (covered > COVERAGE) & (F.when(before > 0, F.try_divide(before, F.col("total"))) < COVERAGE)
    return (
        summed.withColumn("PERCENT_COVERED", covered)
        .withColumn("PRV", F.col("PRV").cast("string"))
        .withColumn("AUX", (covered < COVERAGE) | crosses)
        .withColumn("BEST_PRV", choose(F.col("AUX"), F.col("PRV"), F.lit("others")))
        .select(*shares.columns, "PERCENT_COVERED", "AUX", "BEST_PRV")
    )


def top_provinces(best: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` provinces by share, a top-k report."""
    return best.orderBy(F.desc("PERCENT"), F.asc_nulls_last("PRV")).limit(n)
