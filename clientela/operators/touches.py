"""Sends, and the opens, clicks and failures that touch them.

A touch belongs to a client, a campaign and a delivery. Only the first touch of
a kind counts, and if the time of any touch of that kind is missing, the first
one is unknown and the kind is dropped for that delivery.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clientela.functions.missing import n_distinct
from clientela.operators.events import CLICK, FAIL, OPEN, SEND, is_kind
from clientela.operators.joins import null_safe_join

DELIVERY = ["ID_CLI", "ID_CAMP", "ID_DELIVERY"]

# Suffix of the event id, prefix of the dates and name of the count
# of each kind of touch, as in the results.
_NAMES = {
    OPEN: ("O", "OPEN", "NUM_OPENs"),
    CLICK: ("C", "CLICK", "NUM_CLICKs"),
    FAIL: ("F", "FAIL", None),
}


def sends(clean: DataFrame) -> DataFrame:
    return clean.where(is_kind(SEND)).select(
        F.col("ID_EVENT").alias("ID_EVENT_S"),
        "ID_CLI",
        "ID_CAMP",
        "TYP_CAMP",
        "ID_DELIVERY",
        F.col("EVENT_DATE").alias("SEND_DATE"),
    )


def touch_counts(clean: DataFrame, kind: str) -> DataFrame:
    """Distinct touches of one kind per delivery."""
    name = _NAMES[kind][2]
    return clean.where(is_kind(kind)).groupBy(*DELIVERY).agg(
        n_distinct("ID_EVENT").alias(name)
    )


def first_touches(events: DataFrame, campaign: DataFrame, kind: str) -> DataFrame:
    """First touch of one kind per delivery, with the number of touches.

    ``events`` are typed. They are reduced on ids and times before the campaign's
    type is attached: to events with their first time, which keeps a delivery
    with very many touches spread over the tasks, to times, and to deliveries.
    All three are hash aggregations of flat types. Equal times are told apart by
    the event id. An id with several campaign types has the smallest.
    """
    suffix, prefix, count = _NAMES[kind]
    at = F.col("EVENT_DATETIME")
    per_event = (
        events.where(is_kind(kind))
        .groupBy(*DELIVERY, "ID_EVENT")
        .agg(F.min(at).alias("at"), F.bool_and(at.isNotNull()).alias("dated"))
    )
    per_time = per_event.groupBy(*DELIVERY, "at").agg(
        F.min("ID_EVENT").alias("id"), F.bool_and("dated").alias("dated"), F.count(F.lit(1)).alias("n")
    )
    firsts = (
        per_time.groupBy(*DELIVERY)
        .agg(
            F.min_by("id", "at").alias("id"),
            F.min("at").alias("at"),
            F.bool_and("dated").alias("dated"),
            F.sum("n").alias("touches"),
        )
        .where("dated")
    )
    types = campaign.groupBy("ID_CAMP").agg(F.min("TYP_CAMP").alias("TYP_CAMP"))
    return null_safe_join(firsts, types, ["ID_CAMP"]).select(
        F.col("id").alias(f"ID_EVENT_{suffix}"),
        "ID_CLI",
        "ID_CAMP",
        "TYP_CAMP",
        "ID_DELIVERY",
        F.col("at").alias(f"{prefix}_DATETIME"),
        F.to_date("at").alias(f"{prefix}_DATE"),
        *([F.col("touches").alias(count)] if count else []),
    )


def touch_summary(events: DataFrame, unique_ids: bool = False) -> DataFrame:
    """Opens, clicks and failures per delivery in one row, from one pass.

    Columns per kind: ``<kind>_at`` first time, ``<kind>_known`` whether the
    first touch has an event id, ``<kind>_count`` distinct events; all null if
    the kind is absent or has an unknown time. All aggregates are on flat types,
    so both groupings are hash aggregations with map-side combining.

    The first grouping only makes event ids distinct. Where the source promises
    that every event has an id of its own, ``unique_ids`` leaves it out: touches
    are then combined per delivery before the one shuffle that remains. Nothing
    checks the promise; counts are of events then, and a repeated id counts twice.
    """
    at = F.col("EVENT_DATETIME")
    touched = events.where(is_kind(OPEN) | is_kind(CLICK) | is_kind(FAIL))
    event = [*DELIVERY, "TYP_EVENT", "ID_EVENT"]
    if unique_ids:
        per_event = touched.select(*event, at.alias("at"), at.isNotNull().alias("dated"))
    else:
        per_event = touched.groupBy(*event).agg(
            F.min(at).alias("at"), F.bool_and(at.isNotNull()).alias("dated")
        )
    parts = []
    for code, (_, prefix, _) in _NAMES.items():
        this = is_kind(code)
        parts += [
            F.min(F.when(this, F.col("at"))).alias(f"{prefix}_at"),
            F.min(F.when(this & F.col("ID_EVENT").isNotNull(), F.col("at"))).alias(f"{prefix}_at_id"),
            F.bool_and(F.when(this, F.col("dated"))).alias(f"{prefix}_dated"),
            F.count_if(this).alias(f"{prefix}_count"),
        ]
    grouped = per_event.groupBy(*DELIVERY).agg(*parts)
    columns = []
    for _, prefix, _ in _NAMES.values():
        dated, first = F.col(f"{prefix}_dated"), F.col(f"{prefix}_at")
        with_id = F.coalesce(F.col(f"{prefix}_at_id") == first, F.lit(False))
        columns += [
            F.when(dated, first).alias(f"{prefix}_at"),
            F.when(dated, with_id).alias(f"{prefix}_known"),
            F.when(dated, F.col(f"{prefix}_count")).alias(f"{prefix}_count"),
        ]
    return grouped.select(*DELIVERY, *columns)
