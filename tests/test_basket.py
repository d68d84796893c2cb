"""Frequent sets, pairs and rules against counting in Python."""

import random
from collections import Counter
from itertools import combinations
from math import ceil

import pytest

from clientela.operators import basket
from helpers import plan


def _lines(seed):
    rng = random.Random(seed)
    rows = []
    for ticket in range(120):
        for _ in range(rng.randint(1, 6)):
            rows.append((ticket, f"I{min(rng.randint(0, 7), rng.randint(0, 7))}"))
    return rows


def _sets(rows):
    baskets = {}
    for ticket, item in rows:
        baskets.setdefault(ticket, set()).add(item)
    counts = Counter(
        s for items in baskets.values() for k in range(1, len(items) + 1)
        for s in combinations(sorted(items), k)
    )
    return counts, len(baskets)


@pytest.mark.parametrize("seed,support", [(0, 0.05), (1, 0.1), (2, 0.3)])
def test_against_counting(spark, seed, support):
    rows = _lines(seed)
    counts, tickets = _sets(rows)
    frequent = {s: n for s, n in counts.items() if n >= ceil(support * tickets)}
    baskets = basket.baskets(spark.createDataFrame(rows, "ID_TICKET bigint, ITEM string"), support)
    assert baskets.count() == tickets

    model = basket.basket_model(baskets, support, 0.2)
    got = {tuple(r.ITEMS.split("|")): r.TICKETS for r in basket.frequent_sets(model).collect()}
    assert got == frequent

    pairs = basket.basket_pairs(baskets, support).collect()
    assert {(r.ITEM_A, r.ITEM_B): r.TICKETS for r in pairs} == {
        s: n for s, n in frequent.items() if len(s) == 2
    }
    for r in pairs:
        a, b = counts[r.ITEM_A,], counts[r.ITEM_B,]
        assert r.SUPPORT == r.TICKETS / tickets
        assert (r.CONFIDENCE_AB, r.CONFIDENCE_BA) == (r.TICKETS / a, r.TICKETS / b)
        assert r.LIFT == pytest.approx(r.TICKETS * tickets / a / b)

    want = {
        (tuple(x for x in s if x != c), c): n / counts[tuple(x for x in s if x != c)]
        for s, n in frequent.items() if len(s) > 1 for c in s
    }
    rules = {
        (tuple(r.ANTECEDENT.split("|")), r.CONSEQUENT): r.CONFIDENCE
        for r in basket.basket_rules(model).collect()
    }
    assert rules == {k: v for k, v in want.items() if v >= 0.2}


def test_one_huge_ticket_keeps_only_frequent_items(spark):
    rows = [(0, f"rare{i}") for i in range(3000)] + [(t, item) for t in range(40) for item in "ab"]
    baskets = basket.baskets(spark.createDataFrame(rows, "ID_TICKET bigint, ITEM string"), 0.5)
    sizes = {r.ID_TICKET: len(r["items"]) for r in baskets.collect()}
    assert len(sizes) == 40 and set(sizes.values()) == {2}


def test_lines_are_not_shuffled_by_item(spark, settings):
    """Frequent items go to the lines: only their counts, one per item and task, are shuffled by item."""
    settings(
        spark__sql__autoBroadcastJoinThreshold=-1,
        spark__sql__adaptive__autoBroadcastJoinThreshold=-1,
    )
    rows = [(t, "a") for t in range(400)] + [(t, item) for t in range(0, 400, 2) for item in ("b", f"rare{t}")]
    made = basket.baskets(spark.createDataFrame(rows, "ID_TICKET bigint, ITEM string").repartition(4), 0.5)
    assert {r.ID_TICKET: tuple(sorted(r["items"])) for r in made.collect()} == {
        t: ("a",) if t % 2 else ("a", "b") for t in range(400)
    }
    by_item = [line for line in plan(made).splitlines() if "Exchange hashpartitioning(ITEM" in line]
    assert len(by_item) == 1 and "SortMergeJoin" not in plan(made)


def test_pairs_with_a_third_of_all_lines_in_one_ticket(spark):
    rows = [(0, f"rare{i}") for i in range(300)] + [(0, "a"), (0, "b")]
    rows += [(t, item) for t in range(1, 150) for item in "abcd"[: t % 4 + 1]]
    counts, tickets = _sets([r for r in rows if not r[1].startswith("rare")])
    lines = spark.createDataFrame(rows, "ID_TICKET bigint, ITEM string").repartition(5)
    pairs = basket.basket_pairs(basket.baskets(lines, 0.05), 0.05).collect()
    assert {(r.ITEM_A, r.ITEM_B): r.TICKETS for r in pairs} == {
        s: n for s, n in counts.items() if len(s) == 2 and n >= ceil(0.05 * tickets)
    }


def test_missing_tickets_and_items_are_left_out(spark):
    rows = [(1, "a"), (1, None), (None, "a"), (2, "a")]
    baskets = basket.baskets(spark.createDataFrame(rows, "ID_TICKET bigint, ITEM string"), 0.5)
    assert sorted((r.ID_TICKET, tuple(r["items"])) for r in baskets.collect()) == [(1, ("a",)), (2, ("a",))]


def test_nothing_frequent_no_baskets_and_numbered_items(spark):
    rows = [(t, t) for t in range(20)]
    model = basket.basket_model(basket.baskets(spark.createDataFrame(rows, "ID_TICKET bigint, ITEM bigint"), 0.5), 0.5)
    assert basket.frequent_sets(model).count() == basket.basket_rules(model).count() == 0
    model = basket.basket_model(basket.baskets(spark.createDataFrame([], "ID_TICKET bigint, ITEM string"), 0.5), 0.5)
    assert basket.frequent_sets(model).count() == 0
    rows = [(t, i) for t in range(70) for i in (3, 1, 2)]
    model = basket.basket_model(basket.baskets(spark.createDataFrame(rows, "ID_TICKET bigint, ITEM bigint"), 0.5), 0.5)
    assert {(tuple(r["items"]), r.freq) for r in model.sets.collect()} == {
        (s, 70) for s in [(1,), (2,), (3,), (1, 2), (1, 3), (2, 3), (1, 2, 3)]
    }


def test_an_item_of_every_ticket_is_spread_over_tasks(spark, monkeypatch):
    """Rows of the hot item are as many as blocks of tickets, in many tasks; sets of seven items are found."""
    rows = [(t, c) for t in range(3000) for c in ("a" if t % 4 else "abcdefg")]
    seen = []
    held_by_both = basket._held_by_both

    def kept(held, candidates):
        seen.append(held)
        return held_by_both(held, candidates)

    monkeypatch.setattr(basket, "_held_by_both", kept)
    lines = spark.createDataFrame(rows, "ID_TICKET bigint, ITEM string").repartition(8)
    model = basket.basket_model(basket.baskets(lines, 0.2), 0.2)
    sets = {tuple(r["items"]): r.freq for r in model.sets.collect()}
    assert len(sets) == 127 and sets["a",] == 3000 and sets[tuple("abcdefg")] == 750
    hot = seen[0].where("item = 'a'")
    assert 3000 / 64 <= hot.count() < 150


def test_longer_sets_are_found_within_the_rows_of_their_blocks(spark, settings, monkeypatch):
    """Sets of a block are not joined by block, and a row holds all those of a prefix: 10 rows
    for the 20 sets of three items."""
    settings(
        spark__sql__autoBroadcastJoinThreshold=-1,
        spark__sql__adaptive__autoBroadcastJoinThreshold=-1,
        spark__sql__shuffle__partitions=3,
    )
    rows = [(t, c) for t in range(640) for c in ("abcdef" if t % 10 else ["rare"])]
    made = []
    held_by_both = basket._held_by_both

    def kept(held, candidates):
        made.append(held_by_both(held, candidates))
        return made[-1]

    monkeypatch.setattr(basket, "_held_by_both", kept)
    lines = spark.createDataFrame(rows, "ID_TICKET bigint, ITEM string").repartition(4)
    model = basket.basket_model(basket.baskets(lines, 0.5), 0.5)
    sets = {tuple(r["items"]): r.freq for r in model.sets.collect()}
    assert sets == {s: 576 for k in range(1, 7) for s in combinations("abcdef", k)}
    assert basket.basket_rules(model).count() == sum(len(s) for s in sets if len(s) > 1)
    blocks = made[0].select("block").distinct().count()
    for longer in made:
        longer.collect()
        assert not [line for line in plan(longer).splitlines() if "Exchange" in line and "block" in line]
    assert made[0].count() == 10 * blocks
