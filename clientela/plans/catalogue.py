"""Every query by name: a function of the session and a star-schema folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clientela.operators import (
    addresses,
    basket,
    campaigns,
    charts,
    churn,
    distributions,
    events,
    intervals,
    quality,
    rfm,
    summary,
    survival,
    touches,
)
from clientela.operators.funnel import email_funnel
from clientela.operators.joins import null_safe_join
from clientela.sources import delimited, star_schema as star
from clientela.sources.scratch import scratch_dir, stored

Query = Callable[[SparkSession, str], DataFrame]

# Minimum supports of the basket queries.
PAIR_SUPPORT = 0.02
RULE_SUPPORT = 0.004
RULE_CONFIDENCE = 0.05

# Customers that a campaign addresses first.
TARGETS = 100

FLAGS = {"opened": "OPENED", "clicked": "CLICKED", "failed": "FAILED"}


def typed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.type_events(star.event(spark, sf_dir))


def clean_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.clean_events(star.event(spark, sf_dir), clean_campaigns(spark, sf_dir))


def clean_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaigns.clean_campaigns(star.campaign(spark, sf_dir))


def clean_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.clean_addresses(star.address(spark, sf_dir))


def complete_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.complete_addresses(star.address(spark, sf_dir))


def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return email_funnel(typed_events(spark, sf_dir), clean_campaigns(spark, sf_dir))


def funnel_unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same funnel, given that event ids are unique."""
    return email_funnel(typed_events(spark, sf_dir), clean_campaigns(spark, sf_dir), unique_ids=True)


def funnel_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The funnel of events in which ids, types and dates are missing."""
    rows = na_tokens_default(spark, sf_dir)
    return email_funnel(events.type_events(rows), clean_campaigns(spark, sf_dir))


def na_tokens_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimited.apply_table_rules(star.event_text(spark, sf_dir), "event")


def na_tokens_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimited.apply_table_rules(star.address_text(spark, sf_dir), "address")


def _round_trip(
    name: str, rows: Callable[[SparkSession, str], DataFrame], multiline: bool = False
) -> Query:
    """Write a table as delimited text and scan it again."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = scratch_dir(spark)
        delimited.write_table(rows(spark, sf_dir), folder, name)
        return delimited.scan_table(spark, folder, name, multiline)

    return query


def sink_region_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/df_3_reg.csv"
    delimited.write_csv(dist_region(spark, sf_dir), path)
    return delimited.read_csv(
        spark, path, "REGION string, TOT_ID_ADDRESS bigint, PERCENT double"
    )


def sink_region_csv_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/df_3_reg.csv"
    delimited.write_csv_file(dist_region(spark, sf_dir), path)
    return delimited.read_csv(
        spark, path, "REGION string, TOT_ID_ADDRESS bigint, PERCENT double"
    )


def account_address_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts with the address they refer to; a null id finds the null id."""
    return null_safe_join(
        star.account(spark, sf_dir), clean_addresses(spark, sf_dir), ["ID_ADDRESS"]
    )


# Names of flags and counts in the results of the key audits.
def consistency_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.key_audit(
        star.account(spark, sf_dir), complete_addresses(spark, sf_dir),
        "ID_ADDRESS", "is_in_df_2", "is_in_df_3", "NUM_ID_ADDRESSes",
    )


def consistency_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.key_audit(
        star.fidelity(spark, sf_dir), star.event(spark, sf_dir),
        "ID_CLI", "is_in_df_1", "is_in_df_6", "NUM_ID_CLIs",
    )


def consistency_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.key_audit(
        clean_campaigns(spark, sf_dir), star.event(spark, sf_dir),
        "ID_CAMP", "is_in_df_5", "is_in_df_6", "NUM_ID_CAMPs",
    )


def dist_province(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.province_shares(complete_addresses(spark, sf_dir))


def dist_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.region_shares(complete_addresses(spark, sf_dir))


def best_provinces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.best_provinces(dist_province(spark, sf_dir))


def _first_touches(kind: str) -> Query:
    return lambda spark, sf: touches.first_touches(
        typed_events(spark, sf), clean_campaigns(spark, sf), kind
    )


def days_to_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.days_to_open(funnel(spark, sf_dir))


def days_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.days_to_open_cumulative(days_to_open(spark, sf_dir))


def _flag_shares(flag: str, by_type: bool) -> Query:
    return lambda spark, sf: distributions.flag_shares(funnel(spark, sf), flag, by_type)


def _chart_filled(flag: str, by_type: bool) -> Query:
    shares = _flag_shares(flag, by_type)
    return lambda spark, sf: charts.filled_bars(shares(spark, sf), "TYP_CAMP", "TOT_EVENTs", flag)


def _chart_stacked(flag: str) -> Query:
    shares = _flag_shares(flag, True)
    return lambda spark, sf: charts.bars(shares(spark, sf), "TYP_CAMP", "TOT_EVENTs", flag)


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.repurchase_gaps(star.ticket(spark, sf_dir))


def longest_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.longest_gaps(gaps(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return churn.churn_labels(star.ticket(spark, sf_dir))


def _scored_labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, rfm.Limits]:
    known = stored(labels(spark, sf_dir))
    limits = rfm.rfm_limits(known)
    return rfm.with_scores(known, limits), limits


def churn_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, limits = _scored_labels(spark, sf_dir)
    customers = churn.current_customers(star.ticket(spark, sf_dir))
    return churn.churn_scores(customers, limits, churn.churn_rates(scored))


def churn_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = churn.churn_model(stored(labels(spark, sf_dir)))
    return churn.model_scores(model, churn.current_customers(star.ticket(spark, sf_dir)))


def churn_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return churn.with_engagement(
        churn.money_at_risk(churn_scores(spark, sf_dir)), funnel(spark, sf_dir)
    )


def basket_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tickets = stored(basket.baskets(star.basket(spark, sf_dir), PAIR_SUPPORT))
    return basket.basket_pairs(tickets, PAIR_SUPPORT)


def churn_targets_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    risks = churn.money_at_risk(churn_scores(spark, sf_dir))
    return churn.top_targets(risks, funnel(spark, sf_dir), TARGETS)


def gap_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.survival(survival.purchase_clocks(star.ticket(spark, sf_dir)))


def _basket_model(spark: SparkSession, sf_dir: str) -> basket.BasketModel:
    tickets = basket.baskets(star.basket(spark, sf_dir), RULE_SUPPORT)
    return basket.basket_model(tickets, RULE_SUPPORT, RULE_CONFIDENCE)


QUERIES: dict[str, Query] = {
    # sources and sinks
    "csv_round_trip": _round_trip("event", star.event),
    "csv_round_trip_ticket": _round_trip("ticket", star.ticket),
    "csv_round_trip_address": _round_trip("address", star.address),
    "csv_round_trip_campaign": _round_trip("campaign", star.campaign),
    "csv_round_trip_account": _round_trip("account", star.account),
    "csv_round_trip_fidelity": _round_trip("fidelity", star.fidelity),
    "csv_round_trip_multiline": _round_trip("event", star.event_notes, multiline=True),
    "na_tokens_default": na_tokens_default,
    "na_tokens_address": na_tokens_address,
    "sink_region_csv": sink_region_csv,
    "sink_region_csv_file": sink_region_csv_file,
    # addresses
    "addr_duplicate_audit": lambda s, d: quality.duplicate_audit(
        star.address(s, d), "ID_ADDRESS", "TOT_ID_ADDRESSes"
    ),
    "addr_distinct": lambda s, d: addresses.distinct_addresses(star.address(s, d)),
    "addr_missing_patterns": lambda s, d: quality.missing_patterns(
        star.address(s, d), ["CAP", "PRV", "REGION"], "ID_ADDRESS", "TOT_ADDs"
    ),
    "addr_prv_without_region": lambda s, d: addresses.province_without_region(
        addresses.distinct_addresses(star.address(s, d))
    ),
    "addr_clean": clean_addresses,
    "dist_province": dist_province,
    "dist_region": dist_region,
    "addr_best_prv": best_provinces,
    "top20_province": lambda s, d: addresses.top_provinces(best_provinces(s, d)),
    "chart_best_prv": lambda s, d: charts.stacked_bars(
        best_provinces(s, d), "BEST_PRV", "TOT_ID_ADDRESS"
    ),
    # joins and key consistency
    "null_safe_join": account_address_join,
    "consistency_address": consistency_address,
    "consistency_client": consistency_client,
    "consistency_campaign": consistency_campaign,
    # campaigns and events
    "campaign_clean": clean_campaigns,
    "event_typed": typed_events,
    "event_recode": lambda s, d: events.recode_failures(star.event(s, d)),
    "event_enriched": lambda s, d: events.attach_campaign(star.event(s, d), clean_campaigns(s, d)),
    "event_clean": clean_events,
    "touch_sends": lambda s, d: touches.sends(clean_events(s, d)),
    "touch_opens": _first_touches(events.OPEN),
    "touch_clicks": _first_touches(events.CLICK),
    "touch_fails": _first_touches(events.FAIL),
    "touch_open_counts": lambda s, d: touches.touch_counts(typed_events(s, d), events.OPEN),
    "touch_click_counts": lambda s, d: touches.touch_counts(typed_events(s, d), events.CLICK),
    "funnel": funnel,
    "funnel_unique_ids": funnel_unique_ids,
    "funnel_missing": funnel_missing,
    # funnel summaries
    "overview": lambda s, d: distributions.overview(funnel(s, d)),
    "overview_by_type": lambda s, d: distributions.overview(funnel(s, d), "TYP_CAMP"),
    "dist_num_opens": lambda s, d: distributions.opens_per_send(funnel(s, d)),
    "dist_num_clicks": lambda s, d: distributions.clicks_per_send(funnel(s, d)),
    "days_to_open_hist": days_to_open,
    "days_to_open_cumulative": days_cumulative,
    "chart_days_to_open": lambda s, d: charts.bars(
        charts.short_delays(days_to_open(s, d)), "AVG_DAYS_TO_OPEN", "TOT_CLIs"
    ),
    "chart_days_to_open_cumulative": lambda s, d: charts.short_delays(days_cumulative(s, d)),
    "chart_overview_by_type": lambda s, d: charts.bars(
        distributions.overview(funnel(s, d), "TYP_CAMP"), "TYP_CAMP", "TOT_EVENTs"
    ),
    "chart_num_opens": lambda s, d: charts.bars(
        distributions.opens_per_send(funnel(s, d)), "NUM_OPENs", "TOT_ID_CLI"
    ),
    "chart_num_clicks": lambda s, d: charts.bars(
        distributions.clicks_per_send(funnel(s, d)), "NUM_CLICKs", "TOT_ID_CLI"
    ),
    "flag_share_opened": _flag_shares("OPENED", by_type=False),
    "chart_fill_opened": _chart_filled("OPENED", by_type=False),
    **{f"flag_share_by_type_{name}": _flag_shares(flag, True) for name, flag in FLAGS.items()},
    **{f"chart_stack_by_type_{name}": _chart_stacked(flag) for name, flag in FLAGS.items()},
    **{f"chart_fill_by_type_{name}": _chart_filled(flag, True) for name, flag in FLAGS.items()},
    "funnel_summary": lambda s, d: summary.funnel_summary(
        stored(summary.seen_ids(funnel(s, d))), total_of_none=True
    ),
    # profiles
    "profile_address": lambda s, d: quality.profile(star.address(s, d)),
    "profile_address_clean": lambda s, d: quality.profile(clean_addresses(s, d)),
    "profile_campaign": lambda s, d: quality.profile(star.campaign(s, d)),
    "profile_campaign_clean": lambda s, d: quality.profile(clean_campaigns(s, d)),
    "profile_event": lambda s, d: quality.profile(star.event(s, d)),
    "profile_funnel": lambda s, d: quality.profile(stored(funnel(s, d))),
    "levels_address": lambda s, d: quality.top_levels(star.address(s, d), ["CAP", "PRV", "REGION"]),
    "levels_campaign": lambda s, d: quality.top_levels(
        star.campaign(s, d), ["TYP_CAMP", "CHANNEL_CAMP"]
    ),
    "levels_address_clean": lambda s, d: quality.top_levels(
        clean_addresses(s, d), ["CAP", "PRV", "REGION"]
    ),
    "levels_campaign_clean": lambda s, d: quality.top_levels(clean_campaigns(s, d), ["TYP_CAMP"]),
    "levels_funnel": lambda s, d: quality.top_levels(funnel(s, d), ["TYP_CAMP"]),
    "levels_event": lambda s, d: quality.top_levels(star.event(s, d), ["TYP_EVENT", "EVENT_DATE"]),
    # repurchase interval
    "repurchase_gaps": gaps,
    "max_gap_per_customer": longest_gaps,
    "gap_quantile_90": lambda s, d: intervals.gap_quantile(longest_gaps(s, d)),
    "gap_ecdf": lambda s, d: intervals.gap_distribution(longest_gaps(s, d)),
    "gap_survival": gap_survival,
    "gap_survival_90": lambda s, d: survival.returning_day(gap_survival(s, d)),
    # customer value
    "rfm_base": lambda s, d: rfm.rfm_base(star.ticket(s, d)),
    "rfm_scores": lambda s, d: rfm.rfm_scores(star.ticket(s, d)),
    "rfm_segments": lambda s, d: rfm.rfm_segments(rfm.rfm_scores(star.ticket(s, d))),
    # churn
    "churn_labels": labels,
    "churn_labels_160": lambda s, d: churn.churn_labels(star.ticket(s, d), horizon_days=160),
    "churn_labels_rolling": lambda s, d: churn.rolling_labels(star.ticket(s, d)),
    "churn_scores": churn_scores,
    "churn_quality": lambda s, d: churn.churn_quality(_scored_labels(s, d)[0]),
    "churn_model_scores": churn_model_scores,
    "churn_model_quality": lambda s, d: churn.model_quality(stored(labels(s, d))),
    "churn_targets": churn_targets,
    "churn_targets_top": churn_targets_top,
    # baskets
    "basket_pairs": basket_pairs,
    "basket_sets": lambda s, d: basket.frequent_sets(_basket_model(s, d)),
    "basket_rules": lambda s, d: basket.basket_rules(_basket_model(s, d)),
}
