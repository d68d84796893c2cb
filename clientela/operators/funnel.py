"""The email funnel: one row per send with what happened to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clientela.operators.campaigns import campaign_types
from clientela.operators.events import SEND, is_kind
from clientela.operators.joins import null_safe_join
from clientela.operators.touches import DELIVERY, touch_summary


def email_funnel(
    events: DataFrame, campaign: DataFrame, unique_ids: bool = False
) -> DataFrame:
    """Sends with first open, first click, failure, counts and days to open.

    ``events`` are typed; whether failures are recoded makes no difference. A send
    whose order of dates is impossible (open before send, click before open or
    without one, failure before send) is left out. Dates are compared, not times.

    All touches are reduced to one row per delivery before they meet the sends,
    so three joins become one. The campaign type, which every touch of the
    campaign shares, is attached to the result instead of to all events.
    ``unique_ids`` promises that no two events share an id and none lacks one,
    which saves a shuffle of all touches. It is not checked: a repeated id counts
    as two touches.
    """
    sent = events.where(is_kind(SEND)).select(
        F.col("ID_EVENT").alias("ID_EVENT_S"), *DELIVERY, F.col("EVENT_DATE").alias("SEND_DATE")
    )
    touched = null_safe_join(sent, touch_summary(events, unique_ids), DELIVERY)
    joined = null_safe_join(touched, campaign_types(campaign), ["ID_CAMP"])

    # A campaign id without a row in the campaign table has the null type only.
    own = F.coalesce("IS_FIRST", F.lit(True))
    dated = joined.select(
        "*",
        *(
            F.when(own, F.to_date(f"{kind}_at")).alias(f"{kind}_DATE")
            for kind in ("OPEN", "CLICK", "FAIL")
        ),
        *(
            (own & F.coalesce(f"{kind}_known", F.lit(False))).alias(flag)
            for kind, flag in (("OPEN", "OPENED"), ("CLICK", "CLICKED"), ("FAIL", "FAILED"))
        ),
        F.when(own, F.col("OPEN_count")).alias("NUM_OPENs"),
        F.when(own, F.col("CLICK_count")).alias("NUM_CLICKs"),
    )
    sent_on, opened_on = F.col("SEND_DATE"), F.col("OPEN_DATE")
    clicked_on, failed_on = F.col("CLICK_DATE"), F.col("FAIL_DATE")
    possible = dated.where(
        (opened_on.isNull() | (sent_on <= opened_on))
        & (clicked_on.isNull() | (opened_on <= clicked_on))
        & (failed_on.isNull() | (sent_on <= failed_on))
    )
    # Names and order of the funnel's columns.
    return possible.select(
        "ID_EVENT_S",
        "ID_CLI",
        "ID_CAMP",
        "TYP_CAMP",
        "ID_DELIVERY",
        "SEND_DATE",
        "OPENED",
        "OPEN_DATE",
        F.date_diff("OPEN_DATE", "SEND_DATE").alias("DAYS_TO_OPEN"),
        "NUM_OPENs",
        "CLICKED",
        "CLICK_DATE",
        "NUM_CLICKs",
        "FAILED",
    )
