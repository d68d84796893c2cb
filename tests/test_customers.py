"""Repurchase gaps, RFM and churn against plain Python."""

import random
from collections import defaultdict
from datetime import date, timedelta

import numpy as np
import pytest

from clientela.operators import churn, intervals, rfm
from clientela.operators.events import type_events
from clientela.operators.funnel import email_funnel
from clientela.plans.catalogue import QUERIES
from clientela.sources.scratch import stored

from helpers import campaign_frame, event_frame, sorted_rows

SCHEMA = "ID_TICKET bigint, ID_CLI bigint, TIC_DATE date, AMOUNT double"
START = date(2019, 1, 1)


def _tickets(seed, customers=40, tickets=400, days=300):
    rng = random.Random(seed)
    return [
        (i, rng.randint(1, customers), START + timedelta(rng.randint(0, days)), rng.randint(100, 99999) / 100)
        for i in range(tickets)
    ]


def _by_customer(rows):
    groups = defaultdict(list)
    for ticket, client, day, amount in rows:
        groups[client].append((day, ticket, amount))
    return groups


@pytest.mark.parametrize("seed", range(3))
def test_gaps(spark, seed):
    rows = _tickets(seed)
    want = []
    for client, bought in _by_customer(rows).items():
        days = [d for d, _, _ in sorted(bought)]
        want += [((b - a).days, client) for a, b in zip(days, days[1:]) if b > a]
    gaps = intervals.repurchase_gaps(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r["diff"], r.ID_CLI) for r in gaps.collect()) == sorted(want)

    longest = defaultdict(int)
    for gap, client in want:
        longest[client] = max(longest[client], gap)
    got = {r.ID_CLI: r.Max for r in intervals.longest_gaps(gaps).collect()}
    assert got == dict(longest)
    steps = intervals.gap_distribution(intervals.longest_gaps(gaps)).collect()
    for r in steps:
        assert r.SHARE == sum(v <= r.Max for v in longest.values()) / len(longest)
    assert max(r.SHARE for r in steps) == 1.0


def test_gaps_ignore_missing_clients_and_dates(spark):
    rows = [(1, None, START, 1.0), (2, None, START + timedelta(9), 1.0), (3, 1, None, 1.0), (4, 1, START, 1.0)]
    assert intervals.repurchase_gaps(spark.createDataFrame(rows, SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_rfm(spark, seed):
    rows = _tickets(seed)
    last = max(day for _, _, day, _ in rows)
    base = {
        client: ((last - max(bought)[0]).days, len(bought), round(sum(a for _, _, a in bought), 2))
        for client, bought in _by_customer(rows).items()
    }
    cuts = [np.quantile([v[i] for v in base.values()], [0.2, 0.4, 0.6, 0.8]) for i in range(3)]
    scores = rfm.rfm_scores(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(scores) == len(base)
    for r in scores:
        recency, frequency, monetary = base[r.ID_CLI]
        assert (r.RECENCY, r.FREQUENCY, r.MONETARY) == (recency, frequency, monetary)
        assert r.R_SCORE == 5 - sum(recency > c for c in cuts[0])
        assert r.F_SCORE == 1 + sum(frequency > c for c in cuts[1])
        assert r.M_SCORE == 1 + sum(monetary > c + 1e-9 for c in cuts[2])


def test_segments_cover_everyone_once(spark):
    tickets = spark.createDataFrame(_tickets(7), SCHEMA)
    segments = rfm.rfm_segments(rfm.rfm_scores(tickets)).collect()
    assert sum(r.CUSTOMERS for r in segments) == rfm.rfm_base(tickets).count()
    assert sum(r.CUSTOMER_SHARE for r in segments) == pytest.approx(1.0)
    assert sum(r.SPENT_SHARE for r in segments) == pytest.approx(1.0)


@pytest.mark.parametrize("horizon", [None, 30, 90])
def test_churn_labels(spark, horizon):
    rows = _tickets(1)
    days = horizon
    if days is None:
        longest = []
        for bought in _by_customer(rows).values():
            dates = sorted({d for d, _, _ in bought})
            longest += [max((b - a).days for a, b in zip(dates, dates[1:]))] if len(dates) > 1 else []
        days = int(np.ceil(np.quantile(longest, 0.9)))
    ref = max(r[2] for r in rows) - timedelta(days)
    want = {}
    for client, bought in _by_customer(rows).items():
        before = [b for b in bought if b[0] <= ref]
        if before:
            want[client] = (
                (ref - max(before)[0]).days, len(before), round(sum(a for _, _, a in before), 2),
                all(d <= ref for d, _, _ in bought),
            )
    labels = churn.churn_labels(spark.createDataFrame(rows, SCHEMA), horizon)
    got = {r.ID_CLI: (r.RECENCY, r.FREQUENCY, r.MONETARY, r.CHURNED) for r in labels.collect()}
    assert got == want


def _two_kinds_of_customers(n=300):
    """Half buy weekly to the end, half stopped in the middle."""
    rng, rows = random.Random(9), []
    for client in range(n):
        stop = 360 if client % 2 else 150
        for day in range(rng.randint(0, 6), stop, rng.randint(6, 9)):
            rows.append((len(rows), client, START + timedelta(day), 10.0 + rng.random()))
    return rows


def test_churn_model_tells_leavers_from_stayers(spark):
    tickets = spark.createDataFrame(_two_kinds_of_customers(), SCHEMA)
    labels = stored(churn.churn_labels(tickets, 60))
    quality = churn.model_quality(labels).collect()
    assert len(quality) == 3 and all(r.AUC > 0.95 for r in quality)
    scores = churn.model_scores(churn.churn_model(labels), churn.current_customers(tickets))
    rows = scores.collect()
    assert len(rows) == 300 and all(0 <= r.CHURN_PROBABILITY <= 1 for r in rows)
    leavers = [r.CHURN_PROBABILITY for r in rows if r.ID_CLI % 2 == 0]
    stayers = [r.CHURN_PROBABILITY for r in rows if r.ID_CLI % 2]
    assert min(leavers) > max(stayers)


def _quality(rows):
    """Pairs in order, by counting them all."""
    order = [(p > q) + (p == q) / 2 for p, c in rows for q, d in rows if c and not d]
    return sum(order) / len(order) if order else None


def test_ranking_quality_is_exact(spark):
    rng = random.Random(3)
    rows = [(fold, rng.randint(0, 9) / 9, rng.random() < 0.4) for fold in range(3) for _ in range(200)]
    rows += [(7, 0.5, True), (8, 0.5, False)]
    counts = spark.createDataFrame(
        [(f, p, int(c), int(not c)) for f, p, c in rows],
        "FOLD int, CHURN_PROBABILITY double, positive int, negative int",
    )
    got = {r.FOLD: r.AUC for r in churn.ranking_quality(counts).collect()}
    for fold in got:
        want = _quality([(p, c) for f, p, c in rows if f == fold])
        assert got[fold] == (want if want is None else pytest.approx(want, rel=1e-12))


@pytest.mark.parametrize("seed", range(2))
def test_churn_rates_scores_and_quality(spark, seed):
    tickets = spark.createDataFrame(_tickets(seed, customers=90, tickets=700), SCHEMA)
    labels = stored(churn.churn_labels(tickets, 60))
    limits = rfm.rfm_limits(labels)
    scored = rfm.with_scores(labels, limits)
    rows = scored.collect()

    def rate(cell, others):
        for alike in (cell, cell[:1], ()):
            found = [r.CHURNED for r in others if (r.R_SCORE, r.F_SCORE, r.M_SCORE)[: len(alike)] == alike]
            if found:
                return sum(found) / len(found)

    rates = churn.churn_rates(scored)
    got = {(r.R_SCORE, r.F_SCORE, r.M_SCORE): r.CHURN_PROBABILITY for r in rates.collect()}
    assert len(got) == 125 and all(got[c] == pytest.approx(rate(c, rows)) for c in got)
    customers = churn.current_customers(tickets)
    current = {r.ID_CLI: (r.R_SCORE, r.F_SCORE, r.M_SCORE) for r in rfm.with_scores(customers, limits).collect()}
    scores = {r.ID_CLI: r.CHURN_PROBABILITY for r in churn.churn_scores(customers, limits, rates).collect()}
    assert scores == {i: got[c] for i, c in current.items()}
    quality = {r.FOLD: r.AUC for r in churn.churn_quality(scored).collect()}
    for fold in range(3):
        others = [r for r in rows if r.ID_CLI % 3 != fold]
        held = [(rate((r.R_SCORE, r.F_SCORE, r.M_SCORE), others), r.CHURNED) for r in rows if r.ID_CLI % 3 == fold]
        assert quality[fold] == pytest.approx(_quality(held))


def test_everyone_at_risk_with_their_email_habits(spark):
    scores = spark.createDataFrame(
        [(1, 3, 1, 100.0, 0.5), (2, 3, 1, 30.0, 0.9), (3, 3, 1, 60.0, 0.9)],
        "ID_CLI bigint, RECENCY int, FREQUENCY bigint, MONETARY double, CHURN_PROBABILITY double",
    )
    risks = churn.money_at_risk(scores)
    assert {r.ID_CLI: r.MONEY_AT_RISK for r in risks.collect()} == {1: 50.0, 2: 27.0, 3: 54.0}
    day = "2019-01-02T10:00:00"
    rows = [(10, 1, 1, 1, "S", day), (11, 1, 1, 1, "V", day), (12, 1, 1, 2, "S", day),
            (13, 2, 1, 1, "S", day), (14, None, 1, 1, "S", day)]
    funnel = email_funnel(type_events(event_frame(spark, rows)), campaign_frame(spark))
    out = churn.with_engagement(risks, funnel)
    assert sorted_rows(out.select("ID_CLI", "OPENS", "CLICKS", "SENDS")) == [
        (0, 1, 1, 2), (0, 2, 0, 1), (0, 3, 0, 0),
    ]


def test_nobody_scored_is_left_out_of_the_targets(spark, sf_dir):
    targets, scores = (QUERIES[q](spark, sf_dir) for q in ("churn_targets", "churn_scores"))
    assert targets.count() == scores.count() > 100
