"""What filters do to each other, for every order in which they could run.

A document that fails some of n filters survives a subset of them if it fails
none of that subset. The 2 ** n answers are one word per document, 32 bits for
five filters, taken from a truth table. Counting the documents per bit of these
words gives the survivors of every subset, and every figure of every order is a
difference of two such counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from clientela.llm.batches import as_batch, text_chunks, texts_of
from clientela.sources.scratch import stored

LETTERS = "ABCDE"
# Limits of the filters on one text: words, distinct words and capitals in percent.
FEWEST_WORDS = 200
LEAST_DISTINCT = 50
MOST_CAPITALS = 2
SYMBOLS = b"#$%&*|"

_CAPITALS = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))
_FACTS = pa.schema(
    [("doc_id", pa.int64()), ("part", pa.string()), ("failing", pa.int32()), ("digest", pa.binary())]
)


def failing_alone(text: bytes) -> int:
    """Bits of the filters A to D that a text fails, judged by itself."""
    words = text.split()
    points = len(text) - _count(text, _CONTINUED)
    return (
        (len(words) < FEWEST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
        | (100 * _count(text, _CAPITALS) > MOST_CAPITALS * points) << 2
        | (_count(text, SYMBOLS) > 0) << 3
    )


def _count(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in text_chunks(batch, "text"):
            texts = texts_of(rows, "text")
            found = map(failing_alone, texts), (hashlib.sha256(t).digest() for t in texts)
            yield as_batch(_FACTS, [rows["doc_id"], rows["part"], *map(list, found)])


def failures(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part and the bits of the filters A to E that each row fails.

    E fails texts that a smaller doc_id has too, by their SHA-256. Null texts are
    empty, null parts the empty string. A null id is smaller than none and fails
    no other row; rows that repeat an id do not fail each other.
    """
    named = docs.select(F.col("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text")
    facts = stored(named.mapInArrow(_facts, "doc_id long, part string, failing int, digest binary"))
    # Equal texts are combined in the tasks first, and rows then look up themselves,
    # not their text: a text that most rows share leaves one row per task and is
    # looked up under as many keys as it has ids.
    known = facts.where(F.col("doc_id").isNotNull())
    firsts = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    later = F.when(F.col("is_first").isNull(), 1 << 4).otherwise(0)
    judged = known.join(firsts, ["doc_id", "digest"], "left").select(
        "doc_id", "part", F.col("failing").bitwiseOR(later).alias("failing")
    )
    return judged.unionByName(facts.where(F.col("doc_id").isNull()).select(*judged.columns))


def truth_table(filters: int) -> np.ndarray:
    """By the bits of failed filters: the word whose bit s tells whether the subset s is survived."""
    subsets = np.arange(1 << filters)
    survives = (subsets[:, None] & subsets[None, :]) == 0
    return (survives.astype(np.uint64) << subsets.astype(np.uint64)).sum(axis=1).astype(np.uint32)


def positional_popcounts(words: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Per group and bit: how many of the group's 32-bit words have the bit.

    Full adders take three words of a weight at a time to one of that weight and
    one of twice the weight, for all 32 positions and all groups at once, until
    no group has three of any weight. Only those few are taken apart into bits.
    """
    counts = np.zeros((groups, 32), np.int64)
    order = np.argsort(group, kind="stable")
    words, group = words[order], group[order]
    weight = 1
    while len(words):
        carries, owners = [], []
        while True:
            first = np.searchsorted(group, group)
            place = np.arange(len(group)) - first
            full = (place // 3 + 1) * 3 <= np.bincount(group, minlength=groups)[group]
            a = np.flatnonzero(full & (place % 3 == 0))
            if not len(a):
                break
            x, y, z = words[a], words[a + 1], words[a + 2]
            either = x ^ y
            carries.append((x & y) | (either & z))
            owners.append(group[a])
            rest = np.flatnonzero(~full)
            words = np.concatenate([either ^ z, words[rest]])
            group = np.concatenate([group[a], group[rest]])
            order = np.argsort(group, kind="stable")
            words, group = words[order], group[order]
        bits = (words[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
        np.add.at(counts, group, weight * bits.astype(np.int64))
        words = np.concatenate(carries) if carries else words[:0]
        group = np.concatenate(owners) if owners else group[:0]
        order = np.argsort(group, kind="stable")
        words, group = words[order], group[order]
        weight *= 2
    return counts


_COUNTS = pa.schema(
    [("part", pa.string()), ("good", pa.bool_()), ("toxic", pa.bool_()), ("survivors", pa.list_(pa.int64()))]
)


def _survivors(filters: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = truth_table(filters)
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch["part"].dictionary_encode()
            labels = batch["good"].to_numpy(False).astype(int) + 2 * batch["toxic"].to_numpy(False).astype(int)
            keys, group = np.unique(4 * parts.indices.to_numpy() + labels, return_inverse=True)
            counts = positional_popcounts(table[batch["failing"].to_numpy()], group, len(keys))
            yield as_batch(
                _COUNTS,
                [parts.dictionary.take(pa.array(keys // 4)), keys % 2 == 1, keys % 4 >= 2, counts[:, : 1 << filters].tolist()],
            )

    return count


def subset_survivors(marked: DataFrame, filters: int = len(LETTERS)) -> DataFrame:
    """Survivors of all subsets of at most five filters, one row per part.

    ``marked`` has part, failing (bits of failed filters), good and toxic
    (booleans). Result: part and the arrays documents, good, toxic, whose entry s
    is the number of rows that fail no filter of the subset s. Tasks count their
    batches, so a part of any size sends a few rows per batch.
    """
    counted = marked.select("part", "failing", "good", "toxic").mapInArrow(
        _survivors(filters), "part string, good boolean, toxic boolean, survivors array<long>"
    )
    counts = counted.select("part", "good", "toxic", F.posexplode("survivors").alias("subset", "n"))

    def total(label: str | None) -> Column:
        return F.sum(F.when(F.col(label), F.col("n")).otherwise(0) if label else F.col("n"))

    summed = counts.groupBy("part", "subset").agg(
        total(None).alias("documents"), total("good").alias("good"), total("toxic").alias("toxic")
    )
    names = ("documents", "good", "toxic")
    row = F.array_sort(F.collect_list(F.struct("subset", *names))).alias("row")
    return summed.groupBy("part").agg(row).select("part", *(F.col(f"row.{x}").alias(x) for x in names))


def interactions(survivors: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of the filters and step, from ``subset_survivors``.

    removed: leave at this step; redundant: fail its filter but left earlier;
    unique_fails: fail its filter only; good_lost, toxic_lost: removed rows with
    that label; shapley: removed by the filter, summed over all orders.
    """
    n = len(letters)
    everything = (1 << n) - 1
    # One entry per order and step; their number depends on the letters alone.
    orders, steps, filters, before = [], [], [], []
    for order in permutations(range(n)):
        gone = 0
        for step, i in enumerate(order, 1):
            orders.append("".join(letters[j] for j in order))
            steps.append(step)
            filters.append(i)
            before.append(gone)
            gone |= 1 << i
    plan = F.arrays_zip(
        F.lit(orders).alias("filter_order"), F.lit(steps).alias("step"),
        F.lit(filters).alias("filter"), F.lit(before).alias("before"),
    )

    def lost(counts: str, subset: int, i: int) -> Column:
        return F.get(counts, F.lit(subset)) - F.get(counts, F.lit(subset | 1 << i))

    def over_orders(i: int) -> Column:
        others = [s for s in range(1 << n) if not s >> i & 1]
        ways = [factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) for s in others]
        return _added([w * lost("documents", s, i) for w, s in zip(ways, others, strict=True)])

    per_part = survivors.select(
        "*",
        F.array(*(lost("documents", 0, i) for i in range(n))).alias("fails"),
        F.array(*(lost("documents", everything ^ 1 << i, i) for i in range(n))).alias("unique"),
        F.array(*(over_orders(i) for i in range(n))).alias("shapley"),
    )
    after = F.col("before").bitwiseOR(F.call_function("shiftleft", F.lit(1), F.col("filter")))

    def gone_here(counts: str) -> Column:
        return F.get(counts, F.col("before")) - F.get(counts, after)

    kept = F.get("documents", after)
    removed = gone_here("documents")
    return per_part.select("*", F.inline(plan)).select(
        "part", "filter_order", "step",
        kept.alias("kept"), removed.alias("removed"),
        (F.get("fails", F.col("filter")) - removed).alias("redundant"),
        F.get("unique", F.col("filter")).alias("unique_fails"),
        gone_here("good").alias("good_lost"), gone_here("toxic").alias("toxic_lost"),
        F.get("shapley", F.col("filter")).alias("shapley"),
    )


def _added(terms: Sequence[Column]) -> Column:
    """The sum as a balanced tree, which keeps the expression shallow."""
    if len(terms) == 1:
        return terms[0]
    half = len(terms) // 2
    return _added(terms[:half]) + _added(terms[half:])


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """``interactions`` of the five filters on ``docs``, per value of ``part``.

    ``labels`` has doc_id, quality and toxic; a document is good or toxic if one
    of its rows says so. Rows of ``docs`` that repeat an id count each. Without
    documents there are no parts, so no rows.
    """
    labelled = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    marked = failures(docs, part).join(labelled, "doc_id", "left").fillna(False, ["good", "toxic"])
    return interactions(subset_survivors(marked))
