"""The funnel against its literal meaning, case by case and on random events."""

import random

import pytest

from clientela.operators import distributions
from clientela.operators.events import (
    CLICK, FAIL, OPEN, clean_events, recode_failures, type_events,
)
from clientela.operators.funnel import email_funnel
from clientela.operators.touches import first_touches, touch_counts, touch_summary

from helpers import campaign_frame, event_frame, literal_funnel, sort_rows, sorted_rows


def _funnel(spark, rows, campaigns=((1, "PROMO"), (2, "NEWS"))):
    return email_funnel(type_events(event_frame(spark, rows)), campaign_frame(spark, campaigns))


def _one(spark, rows):
    (row,) = _funnel(spark, rows).collect()
    return row


SEND = (10, 1, 1, 1, "S", "2019-01-02T10:00:00")


def test_open_before_send_removes_the_send(spark):
    assert _funnel(spark, [SEND, (11, 1, 1, 1, "V", "2019-01-01T10:00:00")]).count() == 0


def test_click_without_open_removes_the_send(spark):
    assert _funnel(spark, [SEND, (11, 1, 1, 1, "C", "2019-01-03T10:00:00")]).count() == 0


def test_click_before_open_removes_the_send(spark):
    rows = [SEND, (11, 1, 1, 1, "V", "2019-01-05T10:00:00"), (12, 1, 1, 1, "C", "2019-01-04T10:00:00")]
    assert _funnel(spark, rows).count() == 0


def test_failure_before_send_removes_the_send(spark):
    assert _funnel(spark, [SEND, (11, 1, 1, 1, "B", "2019-01-01T10:00:00")]).count() == 0


def test_earlier_on_the_same_day_is_kept(spark):
    row = _one(spark, [SEND, (11, 1, 1, 1, "V", "2019-01-02T08:00:00")])
    assert (row.OPENED, row.DAYS_TO_OPEN, row.NUM_OPENs) == (True, 0, 1)


def test_unknown_open_time_drops_all_opens_of_the_delivery(spark):
    row = _one(spark, [SEND, (11, 1, 1, 1, "V", "2019-01-03T08:00:00"), (12, 1, 1, 1, "V", "bad")])
    assert (row.OPENED, row.OPEN_DATE, row.DAYS_TO_OPEN, row.NUM_OPENs) == (False, None, None, None)


def test_two_sends_share_the_first_touch(spark):
    again = (20, *SEND[1:])
    rows = _funnel(spark, [SEND, again, (11, 1, 1, 1, "V", "2019-01-04T10:00:00")]).collect()
    assert [(r.OPENED, r.NUM_OPENs, r.DAYS_TO_OPEN) for r in rows] == [(True, 1, 2)] * 2


def test_opens_at_the_same_instant_count_but_make_one_row(spark):
    opens = [(i, 1, 1, 1, "V", "2019-01-04T10:00:00") for i in (12, 11)]
    assert _one(spark, [SEND, *opens]).NUM_OPENs == 2
    events = type_events(event_frame(spark, opens))
    assert [r.ID_EVENT_O for r in first_touches(events, campaign_frame(spark), OPEN).collect()] == [11]


def test_repeated_event_rows_count_once(spark):
    twice = [(11, 1, 1, 1, "V", "2019-01-04T10:00:00")] * 2
    assert _one(spark, [SEND, *twice]).NUM_OPENs == 1


def test_errors_and_bounces_are_failures(spark):
    rows = [(i, 1, 1, 1, kind, "2019-01-04T10:00:00") for i, kind in enumerate(["E", "B", "S", None])]
    recoded = recode_failures(event_frame(spark, rows)).orderBy("ID_EVENT")
    assert [r.TYP_EVENT for r in recoded.collect()] == ["F", "F", "S", None]
    assert _one(spark, [SEND, rows[0]]).FAILED and _one(spark, [SEND, rows[1]]).FAILED


def test_missing_keys_match_missing_keys(spark):
    rows = [(10, None, None, None, "S", SEND[5]), (11, None, None, None, "V", "2019-01-05T00:00:00")]
    row = _one(spark, rows)
    assert (row.OPENED, row.TYP_CAMP, row.DAYS_TO_OPEN) == (True, None, 3)


def test_recoding_before_makes_no_difference(spark):
    rows = _random_events(random.Random(5), 300)
    typed = type_events(event_frame(spark, rows))
    assert sorted_rows(email_funnel(typed, campaign_frame(spark))) == sorted_rows(
        email_funnel(recode_failures(typed), campaign_frame(spark))
    )


def _random_events(rng, n):
    def maybe(value, share=0.06):
        return None if rng.random() < share else value

    return [
        (
            maybe(rng.randint(1, n), 0.03), maybe(rng.randint(1, 4)), maybe(rng.randint(1, 3)),
            maybe(rng.randint(1, 2)), maybe(rng.choice("SSSVVVCEBX")),
            maybe(f"2019-01-{rng.randint(1, 9):02d}T{rng.randint(0, 3):02d}:00:00", 0.02),
        )
        for _ in range(n)
    ]


CAMPAIGN_SETS = {
    "unique": [(1, "PROMO"), (2, "NEWS")],
    "several types per id": [(1, "PROMO"), (1, "NEWS"), (1, "PROMO"), (2, None), (2, "NEWS")],
    "null id": [(1, "PROMO"), (None, "LOST"), (None, "AGAIN")],
    "none": [],
}


@pytest.mark.parametrize("campaigns", CAMPAIGN_SETS.values(), ids=CAMPAIGN_SETS.keys())
@pytest.mark.parametrize("seed", range(4))
def test_random_events_against_the_literal_meaning(spark, seed, campaigns):
    rows = _random_events(random.Random(seed), 40 if seed % 2 else 150)
    got = _funnel(spark, rows, campaigns)
    want = [tuple(row[c] for c in sorted(row)) for row in literal_funnel(rows, campaigns)]
    assert sorted_rows(got) == sort_rows(want)


def test_one_pass_summary_agrees_with_first_touches(spark):
    rows = _random_events(random.Random(11), 400)
    events, campaigns = type_events(event_frame(spark, rows)), campaign_frame(spark)
    summary = {(r.ID_CLI, r.ID_CAMP, r.ID_DELIVERY): r for r in touch_summary(events).collect()}
    for kind, suffix, word, count in ((OPEN, "O", "OPEN", "NUM_OPENs"), (CLICK, "C", "CLICK", "NUM_CLICKs")):
        firsts = first_touches(events, campaigns, kind).collect()
        assert len(firsts) == sum(r[f"{word}_at"] is not None for r in summary.values())
        for r in firsts:
            one = summary[r.ID_CLI, r.ID_CAMP, r.ID_DELIVERY]
            assert one[f"{word}_at"] == r[f"{word}_DATETIME"]
            assert one[f"{word}_count"] == r[count]
            assert one[f"{word}_known"] == (r[f"ID_EVENT_{suffix}"] is not None)
        counts = {(r.ID_CLI, r.ID_CAMP, r.ID_DELIVERY): r[count] for r in touch_counts(events, kind).collect()}
        for r in firsts:
            assert counts[r.ID_CLI, r.ID_CAMP, r.ID_DELIVERY] == r[count]
    assert "NUM_FAILs" not in first_touches(events, campaigns, FAIL).columns


def test_invariants(spark):
    rows = _random_events(random.Random(3), 600)
    funnel = _funnel(spark, rows).collect()
    assert len(funnel) <= sum(r[4] == "S" for r in rows)
    for r in funnel:
        if r.OPENED:
            assert r.OPEN_DATE is not None and r.DAYS_TO_OPEN >= 0
        if r.CLICKED:
            assert r.OPEN_DATE is not None


def test_a_client_counts_in_every_group_it_is_in(spark):
    rows = [SEND, (20, 1, 1, 2, "S", SEND[5]), (21, 1, 1, 2, "V", "2019-01-03T00:00:00")]
    opens = distributions.opens_per_send(_funnel(spark, rows))
    assert {r.NUM_OPENs: (r.TOT_ID_CLI, r.PERCENT) for r in opens.collect()} == {
        None: (1, 0.5), 1: (1, 0.5),
    }
    shares = distributions.flag_shares(_funnel(spark, rows), "OPENED")
    assert {r.OPENED: (r.TOT_EVENTs, r.TOT_CLIs, r.PERCENT_EVENTs, r.PERCENT_CLIs) for r in shares.collect()} == {
        False: (1, 1, 0.5, 1.0), True: (1, 1, 0.5, 1.0),
    }


def test_flag_shares_leave_out_sides_without_sends(spark):
    shares = distributions.flag_shares(_funnel(spark, [SEND]), "CLICKED", by_type=True)
    assert [(r.TYP_CAMP, r.CLICKED, r.PERCENT_EVENTs) for r in shares.collect()] == [("PROMO", False, 1.0)]


def test_overview_dates_are_null_if_one_is_missing(spark):
    rows = [SEND, (20, 2, 1, 1, "S", "bad"), (21, 3, 2, 1, "S", SEND[5])]
    total = distributions.overview(_funnel(spark, rows)).first()
    assert (total.MIN_DATE, total.MAX_DATE, total.TOT_EVENTs, total.TOT_CLIs) == (None, None, 3, 3)
    by_type = {r.TYP_CAMP: r for r in distributions.overview(_funnel(spark, rows), "TYP_CAMP").collect()}
    assert by_type["PROMO"].MIN_DATE is None and by_type["NEWS"].MIN_DATE is not None


def test_days_to_open_is_the_floor_of_the_mean(spark):
    rows = [SEND, (11, 1, 1, 1, "V", "2019-01-03T00:00:00"),
            (20, 1, 2, 1, "S", SEND[5]), (21, 1, 2, 1, "V", "2019-01-06T00:00:00"),
            (30, 2, 1, 1, "S", SEND[5]), (31, 2, 1, 1, "V", "2019-01-02T23:00:00")]
    days = distributions.days_to_open(_funnel(spark, rows))
    assert {r.AVG_DAYS_TO_OPEN: r.TOT_CLIs for r in days.collect()} == {2.0: 1, 0.0: 1}
    covered = distributions.days_to_open_cumulative(days).collect()
    assert [(r.AVG_DAYS_TO_OPEN, r.PERCENT_COVERED) for r in covered] == [(0.0, 0.5), (2.0, 1.0)]
