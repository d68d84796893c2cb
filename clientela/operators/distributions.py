"""Overviews and distributions of the email funnel and of addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clientela.functions.missing import n_distinct, strict_max, strict_min
from clientela.functions.shares import with_running_share, with_share


def distinct_share(df: DataFrame, by: str, key: str, count: str) -> DataFrame:
    """Distinct keys per value and their share of the summed counts, largest first.

    There may be any number of keys and of values.
    """
    counts = df.groupBy(by).agg(n_distinct(key).alias(count))
    return with_share(counts, count, "PERCENT").orderBy(F.desc("PERCENT"), F.asc_nulls_last(by))


# The names of dates, totals and shares in the results below.
def overview(funnel: DataFrame, by: str | None = None) -> DataFrame:
    """First and last send date, distinct sends, distinct clients; overall or per group."""
    return funnel.groupBy(*([by] if by else [])).agg(
        strict_min("SEND_DATE").alias("MIN_DATE"),
        strict_max("SEND_DATE").alias("MAX_DATE"),
        n_distinct("ID_EVENT_S").alias("TOT_EVENTs"),
        n_distinct("ID_CLI").alias("TOT_CLIs"),
    )


def flag_shares(funnel: DataFrame, flag: str, by_type: bool = False) -> DataFrame:
    """Distinct sends and clients with and without a flag, with shares of the total.

    The total is that of all campaigns, or of the campaign type. A client can be
    on both sides of the flag, so client shares may add up to more than 1; hence
    totals are not the sum of the parts. Both come out of one pass: every id is
    reduced to whether it was seen with and without the flag, then the ids are
    counted. Grouping by id first also spreads a dominant campaign type over all
    tasks.
    """
    group = F.col("TYP_CAMP") if by_type else F.lit("ALL")
    ids = funnel.select(group.alias("TYP_CAMP"), flag, "ID_EVENT_S", "ID_CLI").unpivot(
        ["TYP_CAMP", flag], ["ID_EVENT_S", "ID_CLI"], "kind", "id"
    )
    seen = ids.groupBy("TYP_CAMP", "kind", "id").agg(
        F.bool_or(flag).alias("on"), F.bool_or(~F.col(flag)).alias("off")
    )
    is_event, is_client = F.col("kind") == "ID_EVENT_S", F.col("kind") == "ID_CLI"
    counts = seen.groupBy("TYP_CAMP").agg(
        F.count_if(is_event).alias("all_events"),
        F.count_if(is_client).alias("all_clients"),
        *(
            F.count_if(kind & F.col(side)).alias(f"{side}_{name}")
            for side in ("off", "on")
            for name, kind in (("events", is_event), ("clients", is_client))
        ),
    )
    sides = F.array(
        *(
            F.struct(
                F.lit(value).alias(flag),
                F.col(f"{side}_events").alias("TOT_EVENTs"),
                F.col(f"{side}_clients").alias("TOT_CLIs"),
            )
            for value, side in ((False, "off"), (True, "on"))
        )
    )
    return (
        counts.select("TYP_CAMP", "all_events", "all_clients", F.inline(sides))
        .where(F.col("TOT_EVENTs") > 0)
        .select(
            "TYP_CAMP",
            flag,
            "TOT_EVENTs",
            "TOT_CLIs",
            F.try_divide("TOT_EVENTs", "all_events").alias("PERCENT_EVENTs"),
            F.try_divide("TOT_CLIs", "all_clients").alias("PERCENT_CLIs"),
        )
    )


def days_to_open(funnel: DataFrame) -> DataFrame:
    """Clients per whole number of days they take on average to open."""
    per_client = (
        funnel.where("OPENED")
        .groupBy("ID_CLI")
        .agg(F.floor(F.avg("DAYS_TO_OPEN")).cast("double").alias("AVG_DAYS_TO_OPEN"))
    )
    return per_client.groupBy("AVG_DAYS_TO_OPEN").agg(F.count(F.lit(1)).alias("TOT_CLIs"))


def days_to_open_cumulative(days: DataFrame) -> DataFrame:
    """Share of clients who open within so many days; one row per day count."""
    order = F.asc_nulls_last("AVG_DAYS_TO_OPEN")
    return with_running_share(days, "TOT_CLIs", [order], "PERCENT_COVERED").orderBy(order)


def opens_per_send(funnel: DataFrame) -> DataFrame:
    """Clients per number of opens; sends never opened form the null group."""
    return distinct_share(funnel, "NUM_OPENs", "ID_CLI", "TOT_ID_CLI")


def clicks_per_send(funnel: DataFrame) -> DataFrame:
    return distinct_share(funnel, "NUM_CLICKs", "ID_CLI", "TOT_ID_CLI")
