"""Cleaning of the campaign table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def clean_campaigns(campaign: DataFrame) -> DataFrame:
    """Without the channel, which hardly varies."""
    return campaign.drop("CHANNEL_CAMP")


def campaign_types(campaign: DataFrame) -> DataFrame:
    """Campaign ids with their types, marking one type per id as the first.

    Ids should be unique; then every row is the first. Where an id has several
    types, the marked one (the smallest) is the type its touches belong to. A
    window reads the campaigns once, and leaves them on their own side of a later
    join, so that adaptive execution can split a campaign with very many sends.
    """
    first = F.min("TYP_CAMP").over(Window.partitionBy("ID_CAMP"))
    return campaign.select(
        "ID_CAMP", "TYP_CAMP", F.col("TYP_CAMP").eqNullSafe(first).alias("IS_FIRST")
    )
