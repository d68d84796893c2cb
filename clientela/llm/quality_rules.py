"""Quality rules learned as a decision list over statistics of texts.

DataFrame functions only: statistics, counts for the search and verdicts.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame, functions as F

from clientela.llm.batches import bound
from clientela.sources.scratch import stored

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FEATURES = (
    "n_words", "mean_word", "symbol_share", "upper_share", "mark_share", "dup_line_share", "repeat_share",
)

CUTS = 40
MOST_RULES = 12
MOST_CONDITIONS = 4
LEAST_COVERED = 10
# A rule may reject this share of good documents among those it covers.
MOST_WRONG = 0.1
GROW, PRUNE = 0, 1


def _repeated(words: Column) -> Column:
    """Words in windows of three that occur twice or more."""

    def in_twice(ranked: Column) -> Column:
        twice = F.filter(
            ranked,
            lambda x, k: (x["h"] == F.get(ranked, k - 1)["h"]) | (x["h"] == F.get(ranked, k + 1)["h"]),
        )
        covered = F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.size(F.array_distinct(covered))

    def in_windows(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        some_twice = F.size(hashes) > F.size(F.array_distinct(hashes))
        return F.when(some_twice, bound(ranked, in_twice)).otherwise(0)

    places = F.sequence(F.lit(0), F.size(words) - 3)
    hashes = F.transform(
        places, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )
    return F.when(F.size(words) > 2, bound(hashes, in_windows)).otherwise(0)


def text_statistics(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts of the whole text, and their shares.

    ``n_words`` runs of anything but ASCII white space; ``word_chars`` code points
    in them; ``n_symbols`` characters of ``SYMBOLS``; ``n_dup_lines`` lines with a
    word that equal an earlier line; ``n_repeat_words`` words in windows of three
    that the text has more than once. Windows are compared by 64-bit hashes and
    sorted within the document, so repetitive texts take no longer than others.
    Null counts as empty, and a share of nothing is 0. Other columns are not read.
    """
    n_chars = F.char_length("whole")

    def without(chars: str) -> Column:
        return F.char_length(F.translate("whole", chars, ""))

    lines = F.filter(F.split("whole", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    words = F.regexp_extract_all("whole", F.lit(WORD), F.lit(0))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("whole")).select(
        "doc_id",
        n_chars.alias("n_chars"),
        without(BLANKS).alias("word_chars"),
        (n_chars - without(SYMBOLS)).alias("n_symbols"),
        (n_chars - without(CAPITALS)).alias("n_upper"),
        (n_chars - without("!?")).alias("n_marks"),
        bound(
            lines,
            lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")),
        ).alias("lines"),
        bound(words, lambda x: F.struct(F.size(x).alias("n"), _repeated(x).alias("repeat"))).alias("words"),
    )
    found = found.select(
        *("doc_id", "n_chars", "word_chars", "n_symbols", "n_upper", "n_marks"),
        F.col("lines.n").alias("n_lines"),
        F.col("lines.dup").alias("n_dup_lines"),
        F.col("words.n").alias("n_words"),
        F.col("words.repeat").alias("n_repeat_words"),
    )

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    return found.select(
        "doc_id",
        *(F.col(c).cast("long") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        share("word_chars", "n_words").alias("mean_word"),
        share("n_symbols", "n_chars").alias("symbol_share"),
        share("n_upper", "word_chars").alias("upper_share"),
        share("n_marks", "word_chars").alias("mark_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self) -> Column:
        value = F.col(self.feature)
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass(frozen=True)
class Rule:
    """Rejects documents for which all conditions hold."""

    conditions: tuple[Condition, ...]

    def holds(self) -> Column:
        both = F.lit(True)
        for condition in self.conditions:
            both = both & condition.holds()
        return both

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _cuts(rows: DataFrame) -> dict[str, list[float]]:
    """Midpoints between the quantiles of each feature in bad and in good rows.

    Each class has its own quantiles, from its least to its greatest value, so a
    class is divided as finely however rare it is.
    """
    steps = [i / CUTS for i in range(CUTS + 1)]
    kinds = {"bad": F.col("bad"), "good": ~F.col("bad")}
    sums = [
        F.percentile_approx(F.when(own, F.col(f)), steps, 10_000).alias(f"{kind}_{f}")
        for kind, own in kinds.items()
        for f in FEATURES
    ]
    quantiles = rows.agg(*sums).first()
    distinct = {f: sorted({x for kind in kinds for x in quantiles[f"{kind}_{f}"] or []}) for f in FEATURES}
    return {f: [(a + b) / 2 for a, b in zip(q, q[1:], strict=False)] for f, q in distinct.items()}


def _bin(feature: str, cuts: list[float]) -> Column:
    """Number of cuts below the value."""
    limits = F.lit([float(c) for c in cuts]).cast("array<double>")
    return F.size(F.filter(limits, lambda cut: cut < F.col(feature)))


def _grown(rows: DataFrame, cuts: dict[str, list[float]]) -> list[Condition]:
    """Conditions added one by one by their gain of information on bad rows.

    A condition has to gain the bits that it takes to name it among all, so that
    fine cuts do not follow chance. One aggregation per condition: counts by feature and bin, of bounded size.
    """
    conditions: list[Condition] = []
    to_name = log2(max(2, 2 * sum(map(len, cuts.values()))))
    bins = F.array(*(F.struct(F.lit(f).alias("feature"), _bin(f, cuts[f]).alias("bin")) for f in FEATURES))
    binned = rows.select("bad", *FEATURES, F.explode(bins).alias("at")).select("*", "at.feature", "at.bin")
    while len(conditions) < MOST_CONDITIONS:
        here = binned.where(Rule(tuple(conditions)).holds()).groupBy("feature", "bin")
        counts = here.agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).collect()
        table = {(r["feature"], r["bin"]): (r["bad"], r["good"]) for r in counts}
        size = [sum(v[i] for (f, _), v in table.items() if f == FEATURES[0]) for i in (0, 1)]
        if not size[0] or not size[1]:
            break
        before = log2(size[0] / sum(size))
        best: tuple[float, Condition] | None = None
        for feature in FEATURES:
            below = [0, 0]
            for bin_, cut in enumerate(cuts[feature]):
                below = [b + x for b, x in zip(below, table.get((feature, bin_), (0, 0)), strict=True)]
                for above in (False, True):
                    bad, good = [s - b for s, b in zip(size, below, strict=True)] if above else below
                    if bad < LEAST_COVERED:
                        continue
                    gain = bad * (log2(bad / (bad + good)) - before)
                    if best is None or gain > best[0]:
                        best = gain, Condition(feature, above, float(cut))
        if best is None or best[0] <= to_name:
            break
        conditions.append(best[1])
    return conditions


def _pruned(rows: DataFrame, conditions: list[Condition]) -> Rule | None:
    """The first conditions that do best on rows not used for growing, if they do well."""
    starts = [Rule(tuple(conditions[: n + 1])) for n in range(len(conditions))]
    if not starts:
        return None
    sums = []
    for i, rule in enumerate(starts):
        sums += [
            F.count_if(rule.holds() & F.col("bad")).alias(f"bad_{i}"),
            F.count_if(rule.holds() & ~F.col("bad")).alias(f"good_{i}"),
        ]
    counts = rows.agg(*sums).first()

    def worth(i: int) -> float:
        bad, good = counts[f"bad_{i}"], counts[f"good_{i}"]
        return (bad - good) / (bad + good) if bad + good else -1.0

    best = max(range(len(starts)), key=lambda i: (worth(i), -i))
    bad, good = counts[f"bad_{best}"], counts[f"good_{best}"]
    return starts[best] if bad > 0 and good <= MOST_WRONG * (bad + good) else None


def learn_rules(labelled: DataFrame) -> list[Rule]:
    """Decision list from rows of statistics with a boolean ``bad``; nulls are ignored.

    Sequential covering: a rule is grown on two thirds of the rows, pruned on the
    rest, and the rows it covers are taken out before the next, which has cuts of
    its own from the rows left. Learning stops at
    the first rule that fails on the pruning rows. No labels, or labels of one
    kind, give no rules.
    """
    rows = labelled.where("bad is not null").select("bad", *FEATURES, (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 2).alias("held"))
    rows = stored(rows)
    rules: list[Rule] = []
    while len(rules) < MOST_RULES:
        left = rows
        for rule in rules:
            left = left.where(~rule.holds())
        grow = left.where("not held")
        rule = _pruned(left.where("held"), _grown(grow, _cuts(grow)))
        if rule is None:
            break
        rules.append(rule)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The first rule that rejects a document, as text; null if none does."""
    chosen = F.lit(None).cast("string")
    for rule in reversed(rules):
        chosen = F.when(rule.holds(), F.lit(str(rule))).otherwise(chosen)
    return chosen


def apply_rules(statistics: DataFrame, rules: list[Rule]) -> DataFrame:
    """``statistics`` with base_failed, kept and the ``rule`` that rejected."""
    return (
        statistics.withColumn("base_failed", base_failed())
        .withColumn("rule", F.when(~F.col("base_failed"), verdict(rules)))
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )
