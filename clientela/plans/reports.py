"""Whole analyses over the input tables: every figure by name.

Each report stores the one frame that most of its figures are made of, so that
it is computed once, and returns lazy frames.
"""

from __future__ import annotations

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
)
from clientela.operators.funnel import email_funnel
from clientela.sources.delimited import scan_file, scan_table, write_csv
from clientela.sources.scratch import stored
from clientela.sources.tables import LINES

Report = dict[str, DataFrame]

ADDRESS_TEXT = ["CAP", "PRV", "REGION"]


def address_report(address: DataFrame, account: DataFrame, out_dir: str) -> Report:
    clean = stored(addresses.clean_addresses(address), f"{out_dir}/address_clean")
    provinces = addresses.province_shares(clean)
    best = addresses.best_provinces(provinces)
    return {
        "profile_raw": quality.profile(address),
        "levels_raw": quality.top_levels(address, ADDRESS_TEXT),
        "duplicates": quality.duplicate_audit(address, "ID_ADDRESS", "TOT_ID_ADDRESSes"),
        "missing": quality.missing_patterns(
            address, ["CAP", "PRV", "REGION"], "ID_ADDRESS", "TOT_ADDs"
        ),
        "province_without_region": addresses.province_without_region(
            addresses.distinct_addresses(address)
        ),
        "consistency": quality.key_audit(
            account, clean, "ID_ADDRESS", "is_in_df_2", "is_in_df_3", "NUM_ID_ADDRESSes"
        ),
        "provinces": provinces,
        "best_provinces": best,
        "top_provinces": addresses.top_provinces(best),
        "chart_best_provinces": charts.stacked_bars(best, "BEST_PRV", "TOT_ID_ADDRESS"),
        "regions": addresses.region_shares(clean),
        "profile_clean": quality.profile(clean),
        "levels_clean": quality.top_levels(clean, ADDRESS_TEXT),
    }


def email_report(event: DataFrame, campaign: DataFrame, fidelity: DataFrame, out_dir: str) -> Report:
    known = campaigns.clean_campaigns(campaign)
    funnel = stored(email_funnel(events.type_events(event), known), f"{out_dir}/funnel")
    days = distributions.days_to_open(funnel)
    cumulative = distributions.days_to_open_cumulative(days)
    # Overviews and flag shares all count the same reduced ids.
    seen = stored(summary.seen_ids(funnel), f"{out_dir}/funnel_ids")
    of_all, of_types = summary.counts_of_all(seen), summary.counts_by_type(seen)
    opened = summary.shares_of(of_all, "OPENED")
    by_type = summary.overview_of(of_types, by_type=True)
    opens, clicks = distributions.opens_per_send(funnel), distributions.clicks_per_send(funnel)
    report = {
        "profile_raw": quality.profile(event),
        "levels_raw": quality.top_levels(event, ["TYP_EVENT", "EVENT_DATE"]),
        "profile_campaign": quality.profile(campaign),
        "levels_campaign": quality.top_levels(campaign, ["TYP_CAMP", "CHANNEL_CAMP"]),
        "profile_campaign_clean": quality.profile(known),
        "levels_campaign_clean": quality.top_levels(known, ["TYP_CAMP"]),
        "consistency_client": quality.key_audit(
            fidelity, event, "ID_CLI", "is_in_df_1", "is_in_df_6", "NUM_ID_CLIs"
        ),
        "consistency_campaign": quality.key_audit(
            known, event, "ID_CAMP", "is_in_df_5", "is_in_df_6", "NUM_ID_CAMPs"
        ),
        "overview": summary.overview_of(of_all, by_type=False),
        "overview_by_type": by_type,
        "chart_overview_by_type": charts.bars(by_type, "TYP_CAMP", "TOT_EVENTs"),
        "opened": opened,
        "chart_opened": charts.filled_bars(opened, "TYP_CAMP", "TOT_EVENTs", "OPENED"),
        "days_to_open": days,
        "chart_days_to_open": charts.bars(charts.short_delays(days), "AVG_DAYS_TO_OPEN", "TOT_CLIs"),
        "days_to_open_cumulative": cumulative,
        "chart_days_to_open_cumulative": charts.short_delays(cumulative),
        "num_opens": opens,
        "chart_num_opens": charts.bars(opens, "NUM_OPENs", "TOT_ID_CLI"),
        "num_clicks": clicks,
        "chart_num_clicks": charts.bars(clicks, "NUM_CLICKs", "TOT_ID_CLI"),
        "profile_funnel": quality.profile(funnel),
        "levels_funnel": quality.top_levels(funnel, ["TYP_CAMP"]),
    }
    for flag in summary.FLAGS:
        shares = summary.shares_of(of_types, flag)
        report[f"{flag.lower()}_by_type"] = shares
        report[f"chart_stack_{flag.lower()}_by_type"] = charts.bars(
            shares, "TYP_CAMP", "TOT_EVENTs", flag
        )
        report[f"chart_{flag.lower()}_by_type"] = charts.filled_bars(
            shares, "TYP_CAMP", "TOT_EVENTs", flag
        )
    return report


def customer_report(
    ticket: DataFrame, funnel: DataFrame, out_dir: str, horizon_days: int | None = None
) -> Report:
    """Repurchase interval, RFM and churn. Without a horizon the interval is used."""
    gaps = intervals.repurchase_gaps(ticket)
    longest = stored(intervals.longest_gaps(gaps), f"{out_dir}/longest_gap")
    base = stored(rfm.rfm_base(ticket), f"{out_dir}/rfm_base")
    scores = rfm.with_scores(base.drop("LAST_DATE"), rfm.rfm_limits(base))
    labels = stored(churn.churn_labels(ticket, horizon_days), f"{out_dir}/churn_labels")
    limits = rfm.rfm_limits(labels)
    scored = rfm.with_scores(labels, limits)
    risks = churn.churn_scores(base, limits, churn.churn_rates(scored))
    return {
        "repurchase_gaps": gaps,
        "longest_gaps": longest,
        "repurchase_interval": intervals.gap_quantile(longest),
        "gap_distribution": intervals.gap_distribution(longest),
        "rfm_base": base,
        "rfm_scores": scores,
        "rfm_segments": rfm.rfm_segments(scores),
        "churn_labels": labels,
        "churn_quality": churn.churn_quality(scored),
        "churn_scores": risks,
        "churn_targets": churn.with_engagement(churn.money_at_risk(risks), funnel),
    }


def basket_report(
    lines: DataFrame, out_dir: str, min_support: float, min_confidence: float
) -> Report:
    tickets = stored(basket.baskets(lines, min_support), f"{out_dir}/baskets")
    model = basket.basket_model(tickets, min_support, min_confidence)
    return {
        "pairs": basket.basket_pairs(tickets, min_support),
        "sets": basket.frequent_sets(model),
        "rules": basket.basket_rules(model),
    }


def write_reports(
    spark: SparkSession,
    data_dir: str,
    out_dir: str,
    lines: str | None = None,
    min_support: float = 0.01,
    min_confidence: float = 0.1,
) -> None:
    """Scan the tables in ``data_dir`` and write every figure as CSV.

    ``out_dir`` must be a folder that all executors can write to. Baskets need
    the items of a ticket, which are not among the tables: ``lines`` is a
    delimited file in ``data_dir`` with the columns ID_TICKET and ITEM.
    """
    tables = {
        name: scan_table(spark, data_dir, name)
        for name in ("fidelity", "account", "address", "campaign", "event", "ticket")
    }
    email = email_report(
        tables["event"], tables["campaign"], tables["fidelity"], f"{out_dir}/email"
    )
    funnel = spark.read.parquet(f"{out_dir}/email/funnel")
    reports = {
        "address": address_report(tables["address"], tables["account"], f"{out_dir}/address"),
        "email": email,
        "customer": customer_report(tables["ticket"], funnel, f"{out_dir}/customer"),
    }
    if lines is not None:
        items = scan_file(spark, f"{data_dir}/{lines}", LINES)
        reports["basket"] = basket_report(items, f"{out_dir}/basket", min_support, min_confidence)
    for report, figures in reports.items():
        for name, frame in figures.items():
            write_csv(frame, f"{out_dir}/{report}/figures/{name}")
