"""All counts of sends and clients of the funnel from one reduction of its ids.

An id is reduced to what it was seen with: one row per id and campaign type, with
the dates and the sides of the three flags. Every overview and share counts these
rows; only figures over all types have to bring the types of an id together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FLAGS = ("OPENED", "CLICKED", "FAILED")
EVENT, CLIENT = "ID_EVENT_S", "ID_CLI"


def _sides() -> Column:
    """Two bits per flag: seen with it, seen without it. A null flag is neither."""
    bits = F.lit(0)
    for i, flag in enumerate(FLAGS):
        side = F.when(F.col(flag), 1 << 2 * i).when(~F.col(flag), 2 << 2 * i).otherwise(0)
        bits = bits.bitwiseOR(side)
    return bits


def seen_ids(funnel: DataFrame) -> DataFrame:
    """KIND (the id's column), ID, TYP_CAMP and what was seen there: SIDES, dates.

    Nulls of an id are one id. Tasks reduce their own rows first, so an id or a
    type that most rows have is spread; the rows are as many as ids and types
    occur together. Store the result, the figures read it several times.
    """
    ids = funnel.select("TYP_CAMP", _sides().alias("sides"), "SEND_DATE", EVENT, CLIENT).unpivot(
        ["TYP_CAMP", "sides", "SEND_DATE"], [EVENT, CLIENT], "KIND", "ID"
    )
    return ids.groupBy("KIND", "ID", "TYP_CAMP").agg(
        F.bit_or("sides").alias("SIDES"),
        F.min("SEND_DATE").alias("MIN_DATE"),
        F.max("SEND_DATE").alias("MAX_DATE"),
        F.bool_or(F.col("SEND_DATE").isNull()).alias("NO_DATE"),
    )


def _counts(seen: DataFrame, *by: str) -> DataFrame:
    """Distinct ids of each kind, overall and per side of each flag, and the dates."""
    counts = []
    for kind, name in ((EVENT, "events"), (CLIENT, "clients")):
        mine = F.col("KIND") == kind
        counts.append(F.count_if(mine).alias(f"all_{name}"))
        for i, flag in enumerate(FLAGS):
            for side, bit in (("on", 1), ("off", 2)):
                has = F.col("SIDES").bitwiseAND(F.lit(bit << 2 * i)) != 0
                counts.append(F.count_if(mine & has).alias(f"{flag}_{side}_{name}"))
    known = ~F.coalesce(F.bool_or("NO_DATE"), F.lit(False))
    dates = [F.when(known, F.min("MIN_DATE")).alias("MIN_DATE"), F.when(known, F.max("MAX_DATE")).alias("MAX_DATE")]
    return seen.groupBy(*by).agg(*counts, *dates)


def counts_by_type(seen: DataFrame) -> DataFrame:
    """One row per campaign type; no id is shuffled again."""
    return _counts(seen, "TYP_CAMP")


def counts_of_all(seen: DataFrame) -> DataFrame:
    """One row for all campaigns, with TYP_CAMP ALL."""
    ids = seen.groupBy("KIND", "ID").agg(
        F.bit_or("SIDES").alias("SIDES"), F.min("MIN_DATE").alias("MIN_DATE"),
        F.max("MAX_DATE").alias("MAX_DATE"), F.bool_or("NO_DATE").alias("NO_DATE"),
    )
    return _counts(ids).withColumn("TYP_CAMP", F.lit("ALL"))


# The names of dates, totals and shares in the results below.
def overview_of(counts: DataFrame, by_type: bool) -> DataFrame:
    """First and last send date, distinct sends and clients, as ``distributions.overview``."""
    return counts.select(
        *(["TYP_CAMP"] if by_type else []), "MIN_DATE", "MAX_DATE",
        F.col("all_events").alias("TOT_EVENTs"), F.col("all_clients").alias("TOT_CLIs"),
    )


def shares_of(counts: DataFrame, flag: str) -> DataFrame:
    """Sends and clients with and without a flag, as ``distributions.flag_shares``."""
    sides = F.array(
        *(
            F.struct(
                F.lit(value).alias(flag),
                F.col(f"{flag}_{side}_events").alias("TOT_EVENTs"),
                F.col(f"{flag}_{side}_clients").alias("TOT_CLIs"),
            )
            for value, side in ((False, "off"), (True, "on"))
        )
    )
    return (
        counts.select("TYP_CAMP", "all_events", "all_clients", F.inline(sides))
        .where(F.col("TOT_EVENTs") > 0)
        .select(
            "TYP_CAMP", flag, "TOT_EVENTs", "TOT_CLIs",
            F.try_divide("TOT_EVENTs", "all_events").alias("PERCENT_EVENTs"),
            F.try_divide("TOT_CLIs", "all_clients").alias("PERCENT_CLIs"),
        )
    )


def funnel_summary(seen: DataFrame, total_of_none: bool = False) -> DataFrame:
    """Every count and share of the funnel in one table.

    One row per campaign type (ALL is over all), flag and side of it; the rows
    with neither flag nor side are the totals that the shares refer to. Without
    a send there is no row, or with ``total_of_none`` that of ALL, which counts 0.
    """
    rows, least = [], 0 if total_of_none else 1
    for scope, counts in (("all", counts_of_all(seen)), ("type", counts_by_type(seen))):
        head = F.lit(scope).alias("SCOPE")
        for flag in FLAGS:
            shares = shares_of(counts, flag).withColumnRenamed(flag, "SIDE")
            rows.append(shares.select(head, "TYP_CAMP", F.lit(flag).alias("FLAG"), "SIDE", *shares.columns[2:]))
        totals = counts.where(F.col("all_events") >= least).select(
            head, "TYP_CAMP", F.lit(None).cast("string").alias("FLAG"), F.lit(None).cast("boolean").alias("SIDE"),
            F.col("all_events").alias("TOT_EVENTs"), F.col("all_clients").alias("TOT_CLIs"),
            F.lit(1.0).alias("PERCENT_EVENTs"), F.lit(1.0).alias("PERCENT_CLIs"),
        )
        rows.append(totals)
    together = rows[0]
    for part in rows[1:]:
        together = together.unionByName(part)
    return together
