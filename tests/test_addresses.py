"""Address cleaning, audits and the province bucketing with its edge cases."""

import pytest

from clientela.operators import addresses, quality

from helpers import sorted_rows


def _provinces(spark, sizes):
    rows, n = [], 0
    for name, size in sizes.items():
        for _ in range(size):
            n += 1
            rows.append((n, "00100", name, "R"))
    return spark.createDataFrame(rows, "ID_ADDRESS bigint, CAP string, PRV string, REGION string")


def _labels(spark, sizes):
    best = addresses.best_provinces(addresses.province_shares(_provinces(spark, sizes)))
    return {r.PRV: r.BEST_PRV for r in best.collect()}


def test_first_province_above_half_has_no_label(spark):
    assert _labels(spark, {"A": 6, "B": 3, "C": 1}) == {"A": None, "B": "others", "C": "others"}


def test_exactly_half_is_others(spark):
    assert _labels(spark, {"A": 5, "B": 3, "C": 2}) == dict.fromkeys("ABC", "others")


def test_ties_follow_the_name_and_rows_are_summed_one_by_one(spark):
    best = addresses.best_provinces(
        addresses.province_shares(_provinces(spark, {"B": 2, "C": 2, "A": 2}))
    )
    rows = {r.PRV: (r.PERCENT_COVERED, r.BEST_PRV) for r in best.collect()}
    assert rows == {"A": (2 / 6, "A"), "B": (4 / 6, "B"), "C": (1.0, "others")}


def test_coverage_is_the_smallest_set_above_half(spark):
    assert _labels(spark, {"A": 4, "B": 3, "C": 2, "D": 1}) == {
        "A": "A", "B": "B", "C": "others", "D": "others",
    }


def test_cleaning_drops_duplicates_and_incomplete_rows(spark):
    rows = [(1, "1", "A", "R"), (1, "1", "A", "R"), (2, None, "A", "R"), (3, "1", None, "R"),
            (4, "1", "A", None), (None, "1", "A", "R")]
    df = spark.createDataFrame(rows, "ID_ADDRESS bigint, CAP string, PRV string, REGION string")
    assert sorted_rows(addresses.clean_addresses(df).select("ID_ADDRESS")) == [(None,), (1,)]
    audit = quality.duplicate_audit(df, "ID_ADDRESS", "TOT_ID_ADDRESSes").first()
    assert (audit.TOT_ID_ADDRESSes, audit.TOT_ROWs) == (5, 6)
    assert sorted_rows(addresses.province_without_region(df).select("ID_ADDRESS")) == [(4,)]
    patterns = quality.missing_patterns(df, ["CAP", "PRV", "REGION"], "ID_ADDRESS", "n")
    assert {(r.w_CAP, r.w_PRV, r.w_REGION): r.n for r in patterns.collect()} == {
        (True, True, True): 2, (False, True, True): 1, (True, False, True): 1,
        (True, True, False): 1,
    }


def test_last_running_share_is_one(spark):
    best = addresses.best_provinces(
        addresses.province_shares(_provinces(spark, {"A": 7, "B": 3, "C": 3, "D": 1}))
    )
    assert max(r.PERCENT_COVERED for r in best.collect()) == pytest.approx(1.0)


def test_top_provinces_is_a_top_k_report(spark):
    sizes = {f"P{i:02d}": 30 - i for i in range(25)}
    best = addresses.best_provinces(addresses.province_shares(_provinces(spark, sizes)))
    assert [r.PRV for r in addresses.top_provinces(best).collect()] == [f"P{i:02d}" for i in range(20)]
