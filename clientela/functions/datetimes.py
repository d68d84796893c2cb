"""Parsing of ISO date-time text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the accepted layout, year-month-dayThour:minute:second. Fields
# may have one digit; whatever follows the seconds (fraction, zone) is ignored.
ISO_SECONDS = r"^\s*(\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2})"


def parse_iso(column: str) -> Column:
    """Wall-clock timestamp of ISO text, null when it cannot be read.

    The result carries no time zone, so the hour and the date taken from it
    never disagree and do not depend on the session zone.
    """
    return F.regexp_extract(column, ISO_SECONDS, 1).try_cast("timestamp_ntz")
