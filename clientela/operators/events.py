"""Typing, recoding and enrichment of email events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clientela.functions.datetimes import parse_iso
from clientela.operators.joins import null_safe_join

# Event type codes. Errors and bounces are both failures.
SEND, OPEN, CLICK, FAIL = "S", "V", "C", "F"
FAILURES = ("E", "B")


def is_kind(code: str) -> Column:
    """Whether an event is of a kind, before or after failures are recoded.

    A comparison with constants reaches the scan as a pushed filter; one with
    the recoded expression would not.
    """
    codes = (FAIL, *FAILURES) if code == FAIL else (code,)
    return F.col("TYP_EVENT").isin(*codes)


def type_events(event: DataFrame) -> DataFrame:
    """Text date to a timestamp, its hour, and its date under the old name."""
    at = F.col("EVENT_DATETIME")
    return event.withColumn("EVENT_DATETIME", parse_iso("EVENT_DATE")).withColumns(
        {"EVENT_HOUR": F.hour(at), "EVENT_DATE": F.to_date(at)}
    )


def recode_failures(event: DataFrame) -> DataFrame:
    kind = F.col("TYP_EVENT")
    return event.withColumn("TYP_EVENT", F.when(kind.isin(*FAILURES), FAIL).otherwise(kind))


def attach_campaign(event: DataFrame, campaign: DataFrame) -> DataFrame:
    return null_safe_join(event, campaign, ["ID_CAMP"])


def clean_events(event: DataFrame, campaign: DataFrame) -> DataFrame:
    """Typed and recoded events with the columns of their campaign."""
    return attach_campaign(recode_failures(type_events(event)), campaign)
