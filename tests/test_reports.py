"""Reports over delimited files give the figures of the catalogue."""

import pytest

from clientela.plans import reports
from clientela.plans.catalogue import PAIR_SUPPORT, QUERIES, RULE_CONFIDENCE, RULE_SUPPORT
from clientela.sources import star_schema as star
from clientela.sources.delimited import scan_table, write_table

from conftest import TESTDATA
from helpers import sorted_rows

SF = str(TESTDATA / "sf0.001")
TABLES = ("fidelity", "account", "address", "campaign", "event", "ticket")


@pytest.fixture(scope="module")
def data_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("data"))
    for table in TABLES:
        write_table(getattr(star, table)(spark, SF), folder, table)
    return folder


def _same(spark, report, pairs):
    for figure, query in pairs.items():
        assert sorted_rows(report[figure]) == sorted_rows(QUERIES[query](spark, SF)), figure


def test_address_report(spark, data_dir, tmp_path):
    address, account = (scan_table(spark, data_dir, t) for t in ("address", "account"))
    report = reports.address_report(address, account, str(tmp_path))
    _same(
        spark, report,
        {
            "profile_raw": "profile_address", "duplicates": "addr_duplicate_audit",
            "missing": "addr_missing_patterns", "consistency": "consistency_address",
            "province_without_region": "addr_prv_without_region", "provinces": "dist_province",
            "best_provinces": "addr_best_prv", "top_provinces": "top20_province",
            "chart_best_provinces": "chart_best_prv", "regions": "dist_region",
            "profile_clean": "profile_address_clean", "levels_raw": "levels_address",
            "levels_clean": "levels_address_clean",
        },
    )


def test_email_report(spark, data_dir, tmp_path):
    frames = (scan_table(spark, data_dir, t) for t in ("event", "campaign", "fidelity"))
    report = reports.email_report(*frames, str(tmp_path))
    _same(
        spark, report,
        {
            "profile_raw": "profile_event", "profile_campaign": "profile_campaign",
            "consistency_client": "consistency_client", "consistency_campaign": "consistency_campaign",
            "overview": "overview", "overview_by_type": "overview_by_type",
            "opened": "flag_share_opened", "chart_opened": "chart_fill_opened",
            "days_to_open": "days_to_open_hist", "days_to_open_cumulative": "days_to_open_cumulative",
            "num_opens": "dist_num_opens", "num_clicks": "dist_num_clicks",
            "profile_funnel": "profile_funnel", "profile_campaign_clean": "profile_campaign_clean",
            "chart_overview_by_type": "chart_overview_by_type", "chart_days_to_open": "chart_days_to_open",
            "chart_days_to_open_cumulative": "chart_days_to_open_cumulative",
            "chart_num_opens": "chart_num_opens", "chart_num_clicks": "chart_num_clicks",
            "levels_raw": "levels_event", "levels_campaign": "levels_campaign",
            "levels_campaign_clean": "levels_campaign_clean", "levels_funnel": "levels_funnel",
            **{f"chart_stack_{f}_by_type": f"chart_stack_by_type_{f}" for f in ("opened", "clicked", "failed")},
            **{f"{f}_by_type": f"flag_share_by_type_{f}" for f in ("opened", "clicked", "failed")},
            **{f"chart_{f}_by_type": f"chart_fill_by_type_{f}" for f in ("opened", "clicked", "failed")},
        },
    )


def test_customer_and_basket_report(spark, data_dir, tmp_path):
    report = reports.customer_report(
        scan_table(spark, data_dir, "ticket"), QUERIES["funnel"](spark, SF), str(tmp_path)
    )
    names = (
        "repurchase_gaps", "rfm_base", "rfm_scores", "rfm_segments", "churn_labels", "churn_quality",
        "churn_scores", "churn_targets",
    )
    _same(
        spark, report,
        {
            "repurchase_interval": "gap_quantile_90", "gap_distribution": "gap_ecdf",
            "longest_gaps": "max_gap_per_customer", **{n: n for n in names},
        },
    )
    lines = star.basket(spark, SF)
    pairs = reports.basket_report(lines, str(tmp_path / "a"), PAIR_SUPPORT, 0.1)
    _same(spark, pairs, {"pairs": "basket_pairs"})
    rules = reports.basket_report(lines, str(tmp_path / "b"), RULE_SUPPORT, RULE_CONFIDENCE)
    _same(spark, rules, {"sets": "basket_sets", "rules": "basket_rules"})


def test_all_figures_are_written(spark, data_dir, tmp_path):
    lines = star.basket(spark, SF).select("ID_TICKET", "ITEM")
    lines.write.csv(f"{data_dir}/lines.csv", sep=";", header=True)
    reports.write_reports(spark, data_dir, str(tmp_path / "out"), "lines.csv", PAIR_SUPPORT)
    back = spark.read.csv(str(tmp_path / "out/email/figures/overview_by_type"), header=True)
    assert back.count() == 6 and back.columns[0] == "TYP_CAMP"
    written = {p.parts[-3]: 0 for p in (tmp_path / "out").glob("*/figures/*")}
    for p in (tmp_path / "out").glob("*/figures/*"):
        written[p.parts[-3]] += 1
    assert written == {"address": 13, "email": 32, "customer": 11, "basket": 3}
