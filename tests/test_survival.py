"""Survival of purchase clocks and rolling labels against plain Python."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from clientela.operators import churn, survival

from helpers import sorted_rows

SCHEMA = "ID_TICKET bigint, ID_CLI bigint, TIC_DATE date, AMOUNT double"
START = date(2019, 1, 1)


def _tickets(seed, n=400, customers=30, span=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        cli = rng.choice([None, *range(customers)]) if rng.random() < 0.1 else min(rng.randrange(customers), rng.randrange(customers))
        day = None if rng.random() < 0.03 else START + timedelta(rng.randrange(span))
        ticket = None if rng.random() < 0.03 else i // 2
        rows.append((ticket, cli, day, round(rng.uniform(-5, 50), 2)))
    return rows


def _clocks(rows):
    end = max(r[2] for r in rows if r[2])
    clocks = []
    for cli in {r[1] for r in rows if r[1] is not None}:
        days = sorted({r[2] for r in rows if r[1] == cli and r[2]})
        clocks += [((b - a).days, True) for a, b in zip(days, days[1:])]
        clocks += [((end - days[-1]).days, False)] if days else []
    return clocks


@pytest.mark.parametrize("seed", range(3))
def test_product_limit(spark, seed):
    rows = _tickets(seed)
    clocks = _clocks(rows)
    frame = survival.purchase_clocks(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.DAYS, r.RETURNED) for r in frame.collect()) == sorted(clocks)
    share, want = 1.0, []
    for day in sorted({d for d, _ in clocks}):
        at_risk = sum(d >= day for d, _ in clocks)
        returned = sum(d == day and back for d, back in clocks)
        share *= 1 - returned / at_risk
        want.append((day, at_risk, returned, sum(d == day and not back for d, back in clocks), pytest.approx(share, abs=1e-9)))
    curve = survival.survival(frame)
    got = [tuple(r) for r in curve.orderBy("DAYS").collect()]
    assert got == want
    for back in (0.5, 0.9, 0.999):
        row = survival.returning_day(curve, back).first()
        reached = [d for d, _, _, _, s in got if s <= round(1 - back, 9)]
        assert row.DAYS == (min(reached) if reached else None) and row.CLOCKS == len(clocks)


def test_those_who_never_come_back_lengthen_the_interval(spark):
    rows = [(i, i % 50, START + timedelta(10 * (i // 50)), 1.0) for i in range(100)]
    once = [(1000 + i, 1000 + i, START, 1.0) for i in range(300)] + [(5000, 5000, START + timedelta(400), 1.0)]
    curve = survival.survival(survival.purchase_clocks(spark.createDataFrame(rows + once, SCHEMA)))
    row = survival.returning_day(curve).first()
    assert row.DAYS is None and 0.8 < row.LAST_SURVIVAL < 0.95


def test_no_tickets_and_one_ticket(spark):
    none = survival.survival(survival.purchase_clocks(spark.createDataFrame([], SCHEMA)))
    assert none.collect() == []
    assert tuple(survival.returning_day(none).first()) == (None, None, 0)
    one = survival.survival(survival.purchase_clocks(spark.createDataFrame([(1, 1, START, 1.0)], SCHEMA)))
    assert [tuple(r) for r in one.collect()] == [(0, 1, 0, 1, 1.0)]


def _labels(rows, ref, horizon):
    result = []
    for cli in {r[1] for r in rows if r[1] is not None}:
        mine = [r for r in rows if r[1] == cli and r[2]]
        past = [r for r in mine if r[2] <= ref]
        if past:
            last = max(r[2] for r in past)
            tickets = {r[0] for r in past if r[0] is not None}
            result.append(
                (ref, cli, last, (ref - last).days, len(tickets), pytest.approx(sum(r[3] for r in past), abs=1e-6),
                 not any(ref < r[2] <= ref + timedelta(horizon) for r in mine))
            )
    return result


@pytest.mark.parametrize("seed,apart,windows,horizon", [(0, 30, 12, 40), (1, 7, 5, 60), (2, 100, 4, 10), (3, 1, 30, 1)])
def test_rolling_labels(spark, seed, apart, windows, horizon):
    rows = _tickets(seed)
    end = max(r[2] for r in rows if r[2])
    want = []
    for w in range(windows):
        want += _labels(rows, end - timedelta(horizon + apart * w), horizon)
    frame = churn.rolling_labels(spark.createDataFrame(rows, SCHEMA).repartition(3), apart, windows, horizon)
    assert sorted(map(tuple, frame.collect()), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])


def test_the_last_window_is_that_of_the_labels(spark):
    tickets = spark.createDataFrame(_tickets(9), SCHEMA)
    rolling = churn.rolling_labels(tickets, 20, 6)
    last = rolling.where(F.col("REF_DATE") == rolling.agg(F.max("REF_DATE")).scalar()).drop("REF_DATE")
    plain = churn.churn_labels(tickets)
    assert sorted_rows(last) == sorted_rows(plain) and last.count() > 10
    assert rolling.select("REF_DATE").distinct().count() == 6


def test_rolling_labels_have_no_join(spark):
    from helpers import plan

    frame = churn.rolling_labels(spark.createDataFrame(_tickets(1), SCHEMA), 30, 12, 40)
    frame.collect()
    assert "Join" not in plan(frame)
