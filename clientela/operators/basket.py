"""Products that are bought together.

A basket is the set of distinct items of a ticket. Pairs are counted ticket by
ticket. Larger sets are found by the tickets of smaller ones: tickets are dealt
into blocks of 64, the tickets of a set in a block are the bits of one number,
and those of two sets that differ in their last item are the bits that both have.
Sets that differ in their last item only lie in one row, so that longer ones are
found within rows and nothing but their counts is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from clientela.sources.scratch import stored


def _known(lines: DataFrame) -> DataFrame:
    known = F.col("ID_TICKET").isNotNull() & F.col("ITEM").isNotNull()
    return lines.where(known).select("ID_TICKET", "ITEM")


def baskets(lines: DataFrame, min_support: float) -> DataFrame:
    """One row per ticket with its frequent items.

    An item below the minimum support is in no frequent set, so it is left out
    of the array, but its ticket still counts. At most (mean items per ticket) /
    ``min_support`` items can be frequent. That bounds every array, even if one
    ticket holds a large part of all lines. It also lets the frequent items go to
    the lines, which are then shuffled by ticket only and never by item.
    """
    known = _known(lines).distinct()
    tickets = known.select("ID_TICKET").distinct().agg(F.count(F.lit(1))).scalar()
    frequent = (
        known.groupBy("ITEM")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= F.ceil(F.lit(min_support) * tickets))
        .select("ITEM", F.lit(True).alias("is_frequent"))
    )
    return (
        known.join(F.broadcast(frequent), "ITEM", "left")
        .groupBy("ID_TICKET")
        .agg(F.collect_set(F.when(F.col("is_frequent"), F.col("ITEM"))).alias("items"))
    )


@dataclass(frozen=True)
class BasketModel:
    """Frequent sets (items, sorted, and freq), number of tickets, confidence of rules."""

    sets: DataFrame
    tickets: int
    min_confidence: float


def basket_model(baskets: DataFrame, min_support: float, min_confidence: float = 0.0) -> BasketModel:
    """Search of all frequent sets, of any size.

    Runs at once and stores what it needs. A set is its last item after a prefix
    of the others, so the sets with one prefix are the children of one node of a
    trie. Two of them make a candidate one item longer if all its subsets are
    frequent, and the tickets of a candidate are found block by block, in the row
    of its node. All rows of a block are of 64 tickets, so an item of every
    ticket, or of a third of them, is spread like the tickets are. Nothing but
    the numbers of tickets and of sets reaches the driver.
    """
    # Stored, so that no ticket is numbered twice.
    numbered = stored(
        baskets.select(F.monotonically_increasing_id().alias("ticket"), F.array_sort("items").alias("items"))
    )
    total = numbered.count()
    least = max(1, ceil(min_support * total))
    nothing = F.array().cast(numbered.schema["items"].dataType)
    single = numbered.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("freq"))
    found = [stored(single.where(F.col("freq") >= least).select(nothing.alias("prefix"), "item", "freq"))]
    pairs = _pair_counts(numbered).where(F.col("freq") >= least)
    found.append(stored(pairs.select(F.array("a").alias("prefix"), F.col("b").alias("item"), "freq")))
    bit = F.expr("shiftleft(1L, cast(ticket & 63 AS int))")
    alone = (
        numbered.select(F.shiftright("ticket", 6).alias("block"), bit.alias("bit"), F.explode("items").alias("item"))
        .groupBy("block", "item")
        .agg(F.bit_or("bit").alias("bits"))
    )
    root = alone.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("item", "bits"))).alias("children"))
    held = _branches(root.withColumn("prefix", nothing), found[1])
    while True:
        candidates = stored(_candidates(found[-1], len(found)))
        if candidates.isEmpty():
            break
        # Stored, as the next level is made of it twice: to count and to keep the frequent.
        held = stored(held)
        longer = _held_by_both(held, candidates)
        sets = longer.select(_appended("prefix", "item").alias("prefix"), F.inline("children"))
        counts = sets.groupBy("prefix", "item").agg(F.sum(F.bit_count("bits")).alias("freq"))
        found.append(stored(counts.where(F.col("freq") >= least)))
        held = _held_by_both(held, found[-1])
    sets = found[0]
    for level in found[1:]:
        sets = sets.unionByName(level)
    return BasketModel(sets.select(_appended("prefix", "item").alias("items"), "freq"), total, min_confidence)


def _appended(prefix: str, item: str | Column) -> Column:
    return F.concat(F.col(prefix), F.array(item))


def _branches(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Children of the children of ``nodes``, of those in ``sets``.

    ``nodes`` has a row per block and node of the trie: block, prefix, which are
    the items of the node, and children: item and bits of the tickets that hold
    them all, by item. A child gets those of its later siblings with which it
    shares tickets. As ``sets`` has a row per prefix here, it is small beside
    ``nodes``; if it is too large to broadcast, rows with the children travel,
    not pairs of them.
    """
    wanted = sets.groupBy("prefix").agg(F.collect_set("item").alias("wanted")).withColumnRenamed("prefix", "node")
    later = F.slice("children", F.col("place") + 2, F.size("children"))
    both = F.transform(
        later,
        lambda x: F.struct(x["item"].alias("item"), x["bits"].bitwiseAND(F.col("child")["bits"]).alias("bits")),
    )
    placed = nodes.select("block", "prefix", "children", F.posexplode("children").alias("place", "child"))
    made = placed.select(
        "block",
        "prefix",
        F.col("child")["item"].alias("item"),
        F.filter(both, lambda x: x["bits"] != 0).alias("children"),
        _appended("prefix", F.col("child")["item"]).alias("node"),
    )
    in_sets = F.filter("children", lambda x: F.array_contains("wanted", x["item"]))
    return made.join(wanted, "node").select("block", "prefix", "item", in_sets.alias("children"))


def _held_by_both(held: DataFrame, sets: DataFrame) -> DataFrame:
    """Tickets of the sets prefix + item + a + b, from those of prefix + item + a and prefix + item + b.

    ``held`` has block, prefix, item and children, as the result has, whose prefix
    is one item longer; blocks without a ticket have no row or no child.
    """
    return _branches(held.select("block", _appended("prefix", "item").alias("prefix"), "children"), sets)


def _candidates(sets: DataFrame, size: int) -> DataFrame:
    """prefix and item of the sets of ``size`` + 1 items of which all subsets are in ``sets``.

    With a and b for its last two items, the subsets without a or without b are
    the two that the set is made of.
    """
    a = sets.select("prefix", F.col("item").alias("a"))
    b = sets.select("prefix", F.col("item").alias("b"))
    made = a.join(b, "prefix").where("a < b")
    if size > 1:
        places = F.explode(F.sequence(F.lit(0), F.lit(size - 2)))
        other = F.filter("prefix", lambda x, i: i != F.col("dropped"))
        needed = made.withColumn("dropped", places).select(
            "*", F.concat(other, F.array("a")).alias("rest"), F.col("b").alias("last")
        )
        frequent = sets.select(F.col("prefix").alias("rest"), F.col("item").alias("last"))
        kept = needed.join(frequent, ["rest", "last"], "left_semi")
        made = kept.groupBy("prefix", "a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == size - 1)
    return made.select(_appended("prefix", "a").alias("prefix"), F.col("b").alias("item"))


def frequent_sets(model: BasketModel) -> DataFrame:
    """Frequent sets as sorted text, with their size and number of tickets."""
    return model.sets.select(
        F.array_join("items", "|").alias("ITEMS"), F.size("items").alias("SIZE"), F.col("freq").alias("TICKETS")
    )


def basket_rules(model: BasketModel) -> DataFrame:
    """Rules with one item on the right: confidence, lift and support."""
    sets = model.sets
    split = sets.where(F.size("items") > 1).select("items", "freq", F.explode("items").alias("consequent"))
    rest = F.array_except("items", F.array("consequent"))
    left = sets.select(F.col("items").alias("antecedent"), F.col("freq").alias("n_left"))
    right = sets.where(F.size("items") == 1)
    right = right.select(F.get("items", F.lit(0)).alias("consequent"), F.col("freq").alias("n_right"))
    confidence = F.col("freq") / F.col("n_left")
    return (
        split.withColumn("antecedent", rest)
        .join(left, "antecedent")
        .where(confidence >= model.min_confidence)
        .join(right, "consequent")
        .select(
            F.array_join("antecedent", "|").alias("ANTECEDENT"),
            F.col("consequent").alias("CONSEQUENT"),
            confidence.alias("CONFIDENCE"),
            (confidence / (F.col("n_right") / F.lit(model.tickets))).alias("LIFT"),
            (F.col("freq") / F.lit(model.tickets)).alias("SUPPORT"),
        )
    )


def _pair_counts(ordered: DataFrame) -> DataFrame:
    """a, b and freq of all pairs of items of sorted baskets, a before b.

    Counted in the task first: with K frequent items, K being bounded by mean
    items of a ticket / support, a task sends at most K * (K - 1) / 2 rows.
    """
    placed = ordered.select("items", F.posexplode("items").alias("place", "a"))
    later = F.slice("items", F.col("place") + 2, F.size("items"))
    return placed.select("a", F.explode(later).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("freq"))


def basket_pairs(baskets: DataFrame, min_support: float) -> DataFrame:
    """Frequent pairs with support, confidence both ways, and lift.

    ``baskets`` are those of the same minimum support, stored because they are
    read three times. Every basket yields the pairs of its frequent items.
    """
    total = baskets.agg(F.count(F.lit(1))).scalar()
    single = baskets.select(F.explode("items").alias("item")).groupBy("item")
    single = single.agg(F.count(F.lit(1)).alias("freq"))
    a = single.select(F.col("item").alias("ITEM_A"), F.col("freq").alias("n_a"))
    b = single.select(F.col("item").alias("ITEM_B"), F.col("freq").alias("n_b"))
    ordered = baskets.select(F.array_sort("items").alias("items"))
    pairs = (
        _pair_counts(ordered)
        .withColumnsRenamed({"a": "ITEM_A", "b": "ITEM_B", "freq": "TICKETS"})
        .withColumn("total", total)
        .where(F.col("TICKETS") >= F.ceil(F.lit(min_support) * F.col("total")))
    )
    return (
        pairs.join(a, "ITEM_A")
        .join(b, "ITEM_B")
        .select(
            "ITEM_A",
            "ITEM_B",
            "TICKETS",
            F.try_divide("TICKETS", "total").alias("SUPPORT"),
            F.try_divide("TICKETS", "n_a").alias("CONFIDENCE_AB"),
            F.try_divide("TICKETS", "n_b").alias("CONFIDENCE_BA"),
            (F.col("TICKETS") / F.col("n_a") / (F.col("n_b") / F.col("total"))).alias("LIFT"),
        )
    )
