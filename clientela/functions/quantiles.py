"""Exact quantiles of many columns without shuffling their values.

Every value has a key that keeps the order: the leading bits of its logarithm,
so a key's values differ by about one percent. Tasks count their values per key,
with the smallest and the largest of each, and such counts add up. Only keys that
hold a wanted rank are looked at again: those with many different values are
divided once more, those with few are sorted. So no shuffle carries all values
and no task sorts more than a bounded number, whatever the size and the shape of
the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import ceil, floor, fsum

from pyspark.sql import Column, DataFrame, Window, functions as F

# Keys of a power of two; a range that is divided again has BLOCK * BLOCK parts.
BLOCK = 64
# Values of a range that are sorted in one task.
MOST_SORTED = 100_000
# Beyond the exponents of doubles, so that keys of positive values are positive.
_LIFT = 1100


@dataclass(frozen=True)
class Summary:
    """Number and mean of the known values, and the quantiles asked for."""

    count: int
    mean: float | None
    quantiles: list[float | None]


@dataclass
class _Span:
    """Values of a column from low to high, with the ranks that are wanted there."""

    column: str
    low: float
    high: float
    before: int
    ranks: set[int]

    def holds(self) -> Column:
        return F.col(self.column).between(F.lit(self.low), F.lit(self.high))

    def key(self, block: int) -> Column:
        """Which of equal parts of the span a value is in; low and high are in different ones."""
        parts = block * block
        place = (F.col(self.column) - F.lit(self.low)) / F.lit(self.high - self.low)
        return F.when(self.holds(), F.least(F.floor(place * parts), F.lit(parts - 1)))


def leading_key(column: str, block: int = BLOCK) -> Column:
    """A whole number that never falls where the value rises.

    Logarithm, product and floor are monotone in floating point. Infinite values
    and NaN, the largest value in SQL, have keys of their own.
    """
    value = F.col(column)
    size = F.abs(value)
    last = 4 * _LIFT * block
    key = (
        F.when(F.isnan(value) | (size == float("inf")), F.lit(last))
        .when(size == 0, F.lit(0))
        .otherwise(F.floor(F.log2(size) * block) + _LIFT * block)
    )
    signed = F.when(value < 0, -key).otherwise(key)
    return F.when(F.isnan(value), F.lit(last + 1)).when(value.isNotNull(), signed)


def _counted(values: DataFrame, columns: Sequence[str], keys: Sequence[Column]) -> dict[int, list]:
    """Per column number, in the order of keys: rows of n, low, high and total per key."""
    cells = [
        F.struct(F.lit(i).alias("span"), key.cast("bigint").alias("key"), F.col(column).alias("value"))
        for i, (column, key) in enumerate(zip(columns, keys, strict=True))
    ]
    found = (
        values.select(F.inline(F.array(*cells)))
        .where(F.col("key").isNotNull())
        .groupBy("span", "key")
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"),
            F.sum("value").alias("total"),
        )
    )
    counts: dict[int, list] = {}
    # The numbers of keys and of parts bound these rows.
    for row in sorted(found.collect(), key=lambda r: (r["span"], r["key"])):
        counts.setdefault(row["span"], []).append(row)
    return counts


def _sorted_values(values: DataFrame, spans: list[_Span]) -> dict[tuple[str, int], float]:
    """The values at the ranks of spans that hold few values."""
    cells = F.array(
        *(
            F.struct(F.lit(i).alias("span"), F.when(s.holds(), F.col(s.column)).alias("value"))
            for i, s in enumerate(spans)
        )
    )
    counts = values.select(F.inline(cells)).where(F.col("value").isNotNull())
    counts = counts.groupBy("span", "value").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("span").orderBy("value"))
    ranks = F.array(*(F.array(*(F.lit(r - s.before) for r in sorted(s.ranks))) for s in spans))
    found = (
        counts.withColumn("upto", upto)
        .withColumn("rank", F.explode(F.get(ranks, F.col("span"))))
        .where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    )
    # One row per rank asked for.
    return {
        (spans[r["span"]].column, r["rank"] + spans[r["span"]].before): r["value"]
        for r in found.select("span", "rank", "value").collect()
    }


def exact_quantiles(
    df: DataFrame,
    columns: Mapping[str, Column],
    probs: Sequence[float],
    block: int = BLOCK,
    most: int = MOST_SORTED,
) -> dict[str, Summary]:
    """Quantiles of columns of doubles, with linear interpolation between ranks.

    Runs at once: two passes over ``df`` unless a key with a wanted rank has more
    than ``most`` values, so store ``df`` if it is costly. The driver sees counts,
    at most ``block`` per power of two and column, and ``block ** 2`` per rank
    that is looked for again. Nulls are left out; a column of nulls has the count 0.
    """
    names = {name: f"v{i}" for i, name in enumerate(columns)}
    values = df.select(*(columns[name].cast("double").alias(v) for name, v in names.items()))
    parts = list(names.values())
    counts = _counted(values, parts, [leading_key(v, block) for v in parts])
    totals, means, places = {}, {}, {}
    at: dict[tuple[str, int], float] = {}
    few: list[_Span] = []
    wide: list[_Span] = []

    def sort_out(column: str, ranks: set[int], before: int, rows: list) -> None:
        """Find the wanted ranks among counted keys: known, few or to be divided."""
        for row in rows:
            here = {r for r in ranks if before <= r < before + row["n"]}
            if here and not row["low"] < row["high"]:
                at.update({(column, r): row["low"] for r in here})
            elif here:
                (few if row["n"] <= most else wide).append(_Span(column, row["low"], row["high"], before, here))
            before += row["n"]

    for i, v in enumerate(parts):
        rows = counts.get(i, [])
        n = totals[v] = sum(r["n"] for r in rows)
        means[v] = _sum([r["total"] for r in rows]) / n if n else None
        places[v] = [p * (n - 1) for p in probs] if n else []
        sort_out(v, {r for x in places[v] for r in (floor(x), ceil(x))}, 0, rows)
    while wide:
        spans, wide = wide, []
        counts = _counted(values, [s.column for s in spans], [s.key(block) for s in spans])
        for i, span in enumerate(spans):
            sort_out(span.column, span.ranks, span.before, counts[i])
    if few:
        at.update(_sorted_values(values, few))

    def quantile(column: str, place: float) -> float:
        low, high = at[column, floor(place)], at[column, ceil(place)]
        weight = place - floor(place)
        return low if low == high else (1 - weight) * low + weight * high

    return {
        name: Summary(totals[v], means[v], [quantile(v, x) for x in places[v]] or [None] * len(probs))
        for name, v in names.items()
    }


def _sum(numbers: list[float]) -> float:
    """Exact where all are finite."""
    try:
        return fsum(numbers)
    except (OverflowError, ValueError):
        return sum(numbers)
