"""Rates of documents that bring soft domains to target shares of tokens.

A classifier learned from a labelled table gives each document a probability of
every domain. Its tokens then belong to all domains by those probabilities, and
nonnegative document rates are fitted by projected gradient steps so that the
expected tokens of the domains, rate x tokens x probability, come as near to the
targets as least squares can. The clean domain sets the scale of the targets.
DataFrame functions only; the driver solves for one number per domain.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from math import inf, log
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from clientela.llm.batches import free_name
from clientela.sources.scratch import stored

# Upper limits of the bins of every statistic; the last bin is open.
STATISTICS = {
    "n_words": (0, 20, 60, 150, 400, 1000, 4000),
    "symbol_share": (0.0, 0.002, 0.01, 0.03, 0.08, 0.15),
    "upper_share": (0.0, 0.02, 0.05, 0.1, 0.3),
    "word_length": (3.0, 4.5, 5.5, 6.5, 8.0, 10.0),
    "distinct_share": (0.1, 0.2, 0.35, 0.5, 0.7, 0.9),
}
SYMBOLS = "#*$%&|<>!"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Bounds of the sample that the classifier learns from and of the words that
# tell of one domain.
MOST_LABELLED = 20_000
VOCABULARY = 4000
LEAST_DOCUMENTS = 10
# How much more frequent than overall a word is in the domain it tells of, and
# the log likelihood ratio by which it is so: chance reaches it once in 10^5 words.
LEAST_LIFT = 3.0
LEAST_SURPRISE = 10.0
# Words' log odds are looked up by hash, in so many lists.
BUCKETS = 4096
# How often a document of a scarce domain is taken at most; others are never repeated.
MOST_RATE = 4.0
# The part of what repeating gives that a scarce domain's target asks for at most.
ATTAINED = 0.98
# The part of the clean domain that targets may shrink to where domains overlap.
LEAST_SCALE = 0.02
# Targets are met if no domain misses by more than this share of all wanted tokens,
# and out of reach if one still misses by more than UNMET when the steps end.
CLOSE = 1e-6
UNMET = 1e-3
MOST_PASSES = 60
# Multiples of a step by all documents, which is sure to lower the misses, and of
# one by the documents that are free to move, that one pass tries.
TRIED_ALL = (1.0, 4.0, 20.0)
TRIED_FREE = (1.0, 0.4, 0.1)
# Domains with a smaller share of the tokens do not set the scale.
NEGLIGIBLE = 1e-3


@dataclass(frozen=True)
class DomainModel:
    """Naive Bayes: log probabilities of priors, of bins, and of words there or not."""

    priors: dict[str, float]
    bins: dict[str, dict[str, list[float]]]
    words: dict[str, dict[str, tuple[float, float]]]
    # Whether two domains had labelled documents.
    tells: bool


def described(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the statistics and distinct words of each text; null as empty.

    Words are in lower case, without ASCII punctuation, between ASCII white space.
    """
    own = [F.col(c).alias(f"{c}_") for c in keep]
    found = docs.select(*own, F.coalesce(F.col("text"), F.lit("")).alias("text_"))
    chars = F.char_length("text_")
    stripped = F.translate(F.lower("text_"), PUNCTUATION, "")
    found = found.select(
        *(f"{c}_" for c in keep),
        chars.alias("n_chars"),
        (chars - F.char_length(F.translate("text_", SYMBOLS, ""))).alias("n_symbols"),
        (chars - F.char_length(F.translate("text_", CAPITALS, ""))).alias("n_upper"),
        F.array_remove(F.split(stripped, r"[ \t-\r]+"), "").alias("all_words"),
    )
    found = found.withColumn("words", F.array_distinct("all_words"))
    n_words = F.size("all_words")
    return found.select(
        *(F.col(f"{c}_").alias(c) for c in keep),
        n_words.cast("long").alias("n_words"),
        F.try_divide("n_symbols", "n_chars").alias("symbol_share"),
        F.try_divide("n_upper", "n_chars").alias("upper_share"),
        F.try_divide(F.col("n_chars"), n_words).alias("word_length"),
        F.try_divide(F.size("words"), n_words).alias("distinct_share"),
        "words",
    )


def _bin(statistic: str) -> Column:
    """Number of the bin; the first for a statistic of nothing."""
    value = F.coalesce(F.col(statistic), F.lit(0.0)).cast("double")
    limits = F.lit([float(x) for x in STATISTICS[statistic]])
    return F.size(F.filter(limits, lambda limit: limit < value))


def fit_domains(
    docs: DataFrame, labelled: DataFrame, domains: list[str], most: int = MOST_LABELLED
) -> DomainModel:
    """Classifier of texts from the rows (doc_id, domain) of ``labelled``.

    Learns from the ``most`` labelled documents with the smallest hashed ids. An
    id that is labelled twice counts with its first domain by name; nulls and
    other domains than ``domains`` do not count. Without labels all are alike.
    """
    ids = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains))
    ids = ids.groupBy("doc_id").agg(F.min("domain").alias("domain_"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # ``most`` bounds this broadcast.
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    sample = stored(described(sample, "domain_"))

    seen = sample.select("domain_", F.explode("words").alias("word")).groupBy("word")
    seen = seen.agg(
        F.count(F.lit(1)).alias("documents"),
        *(F.count_if(F.col("domain_") == d).alias(f"in_{i}") for i, d in enumerate(domains)),
    )
    seen = stored(seen.where(F.col("documents") >= LEAST_DOCUMENTS))
    counts = {row[0]: row[1] for row in sample.groupBy("domain_").count().collect()}
    size = {d: counts.get(d, 0) for d in domains}
    total = max(1, sum(size.values()))
    # A word tells of a domain by its lift and log likelihood ratio there.
    telling: dict[str, list[int]] = {}
    for i, d in enumerate(domains):
        if not 0 < size[d] < total:
            continue
        inside, share = F.col(f"in_{i}"), size[d] / total
        times = inside / (F.col("documents") * share)
        outside = F.col("documents") - inside
        rest = outside / (F.col("documents") * (1 - share))
        surprise = inside * F.log(times) + F.when(outside > 0, outside * F.log(rest)).otherwise(0.0)
        own = seen.where((times >= LEAST_LIFT) & (surprise >= LEAST_SURPRISE))
        for row in own.orderBy(F.desc(surprise), "word").limit(VOCABULARY).collect():
            telling[row["word"]] = [row[f"in_{j}"] for j in range(len(domains))]
    vocabulary = sorted(telling)

    sums = [
        F.count_if(_bin(s) == b).alias(f"{s}_{b}")
        for s, limits in STATISTICS.items()
        for b in range(len(limits) + 1)
    ]
    rows = {row["domain_"]: row.asDict() for row in sample.groupBy("domain_").agg(*sums).collect()}
    none: dict[str, int] = {}

    def bin_logs(domain: str, statistic: str) -> list[float]:
        width = len(STATISTICS[statistic]) + 1
        row = rows.get(domain, none)
        return [log((row.get(f"{statistic}_{b}", 0) + 1) / (size[domain] + width)) for b in range(width)]

    def word_logs(domain: str, word: str) -> tuple[float, float]:
        p = (telling[word][domains.index(domain)] + 0.5) / (size[domain] + 1)
        return log(p), log(1 - p)

    # A domain without labels has no probability, unless none has labels.
    priors = {
        d: log((size[d] + 1) / (sum(size.values()) + len(domains))) if size[d] or not counts else -inf
        for d in domains
    }
    return DomainModel(
        priors,
        {d: {s: bin_logs(d, s) for s in STATISTICS} for d in domains},
        {d: {w: word_logs(d, w) for w in vocabulary} for d in domains},
        sum(n > 0 for n in size.values()) > 1,
    )


def _bucket(word: Column) -> Column:
    return (F.crc32(word.cast("binary")) % BUCKETS).cast("int")


def _odds(model: DomainModel, vocabulary: list[str]) -> Column:
    """Log odds of a word's presence by domain, as a constant: bucket, word, domain."""
    buckets: list[dict[str, list[float]]] = [{} for _ in range(BUCKETS)]
    hashes = [crc32(w.encode()) % BUCKETS for w in vocabulary]
    for w, bucket in zip(vocabulary, hashes, strict=True):
        buckets[bucket][w] = [present - absent for present, absent in (own[w] for own in model.words.values())]
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,array<double>>>")


def domain_posteriors(docs: DataFrame, model: DomainModel) -> DataFrame:
    """doc_id, tokens (words) and the probability ``p_<domain>`` of each domain."""
    found = described(docs, "doc_id")
    domains = list(model.priors)
    vocabulary = sorted({w for words in model.words.values() for w in words})
    found = found.select(
        "doc_id",
        F.col("n_words").alias("tokens"),
        *(_bin(s).alias(f"bin_{s}") for s in STATISTICS),
        F.filter("words", lambda w: w.isin(vocabulary)).alias("told"),
    )
    odds_of = _odds(model, vocabulary)
    found = found.withColumn(
        "told", F.transform("told", lambda w: F.element_at(F.get(odds_of, _bucket(w)), w))
    )
    logs = []
    for i, d in enumerate(domains):
        value = F.lit(model.priors[d] + sum(absent for _, absent in model.words[d].values()))
        for s in STATISTICS:
            value += F.element_at(F.lit(model.bins[d][s]), F.col(f"bin_{s}") + 1)
        told = F.aggregate("told", F.lit(0.0), lambda sum_, odds: sum_ + F.get(odds, i))
        logs.append((value + told).alias(f"log_{i}"))
    found = found.select("doc_id", "tokens", *logs)
    top = F.greatest(*(f"log_{i}" for i in range(len(domains)))) if len(domains) > 1 else F.col("log_0")
    odds = [F.exp(F.col(f"log_{i}") - top) for i in range(len(domains))]
    found = found.select("doc_id", "tokens", *(o.alias(f"odds_{i}") for i, o in enumerate(odds)))
    all_ = sum((F.col(f"odds_{i}") for i in range(1, len(domains))), F.col("odds_0"))
    return found.select(
        "doc_id", "tokens", *((F.col(f"odds_{i}") / all_).alias(f"p_{d}") for i, d in enumerate(domains))
    )


@dataclass(frozen=True)
class Targets:
    """What the domains have and are to have.

    The clean domain is the one with the largest weight of those with more than a
    negligible share of the tokens. ``scale`` tokens per unit of weight leave it
    whole. A domain that has too little for that is scarce: its documents may be
    taken ``most`` times, and its target is nearly what that gives at most.
    """

    domains: list[str]
    has: np.ndarray
    moments: np.ndarray
    weights: np.ndarray
    clean: int
    most: float

    @property
    def scale(self) -> float:
        return float(self.has[self.clean] / self.weights[self.clean])

    @property
    def scarce(self) -> np.ndarray:
        return self.has < self.scale * self.weights

    def at(self, scale: float) -> np.ndarray:
        repeated = (self.most - 1) * self.moments @ self.scarce
        return np.minimum(scale * self.weights, self.has + ATTAINED * repeated)

    def limit(self) -> Column:
        """Upper limit of a document's rate: 1, and up to ``most`` by its part in scarce domains."""
        part = F.lit(0.0)
        for d, scarce in zip(self.domains, self.scarce, strict=True):
            part = part + F.col(f"p_{d}") if scarce else part
        return F.lit(1.0) + F.lit(self.most - 1) * part


@dataclass(frozen=True)
class _Tried:
    """Expected tokens by domain after a step, and p p' summed over tokens that can go on."""

    expected: np.ndarray
    free: np.ndarray


def _table(steps: list[np.ndarray]) -> Column:
    """Steps as one constant. Numbers of a table are no part of the compiled code,
    so that every pass runs the code of the one before."""
    return F.from_json(F.lit(json.dumps([s.tolist() for s in steps])), "array<array<double>>")


def _along(domains: list[str], step: Column) -> Column:
    """How far a document's rate falls in a step of so much per domain."""
    return sum((F.col(f"p_{d}") * F.get(step, F.lit(i)) for i, d in enumerate(domains)), F.lit(0.0))


def _moved(rate: Column, domains: list[str], step: Column) -> Column:
    """The rate after a step, put back between 0 and its limit."""
    return F.greatest(F.lit(0.0), F.least(F.col("limit"), rate - _along(domains, step)))


def _rate(domains: list[str], steps: list[np.ndarray]) -> Column:
    """The rate that all steps from 1 lead to."""
    return F.aggregate(_table(steps), F.lit(1.0), lambda rate, step: _moved(rate, domains, step))


def _try(limited: DataFrame, domains: list[str], made: list[np.ndarray], steps: list[np.ndarray]) -> list[_Tried]:
    """One pass over the documents: what each of ``steps`` would give after those ``made``."""
    n, p = len(domains), [f"`p_{d}`" for d in domains]
    rated = limited.withColumn("rate", _rate(domains, made)).withColumn("steps", _table(steps))
    along = {
        f"along_{j}": F.expr(" + ".join(f"{p[d]} * steps[{j}][{d}]" for d in range(n))) for j in range(len(steps))
    }
    after = {f"after_{j}": F.expr(f"greatest(0D, least(limit, rate - along_{j}))") for j in range(len(steps))}
    tried, sums = rated.withColumns(along).withColumns(after), []
    for j in range(len(steps)):
        inside = f"(after_{j} > 0 or along_{j} < 0) and (after_{j} < limit or along_{j} > 0)"
        sums += [F.expr(f"sum(after_{j} * tokens * {x})") for x in p]
        sums += [F.expr(f"sum(if({inside}, tokens, 0) * {p[a]} * {p[b]})") for a in range(n) for b in range(a, n)]
    row = np.array([float(x or 0) for x in tried.agg(*sums).first()]).reshape(len(steps), -1)
    return [_Tried(one[:n], _symmetric(one[n:], n)) for one in row]


def _symmetric(upper: np.ndarray, n: int) -> np.ndarray:
    full = np.zeros((n, n))
    full[np.triu_indices(n)] = upper
    return full + np.triu(full, 1).T


def document_rates(
    posteriors: DataFrame, weights: Mapping[str, float], most: float = MOST_RATE
) -> DataFrame:
    """``posteriors`` with a nonnegative ``rate`` per document.

    Least squares of the domains' expected tokens to the targets by projected
    gradient steps from rate 1. Misses are measured by the inverse of the domains'
    second moments, in which a full step by all documents never overshoots; longer
    ones, and steps scaled by the documents that are not at a bound, are tried in
    the same pass and the best one counts. A step is one number per domain, and a
    document's rate moves by its probabilities times these, so all that a step has
    to know of the corpus are a few sums.

    Targets leave the clean domain whole, others at their weight beside it. Where
    that is out of reach, because documents are of several domains, all targets
    shrink together as little as the steps need, down to ``LEAST_SCALE``. If even
    this leaves a miss above ``UNMET``, the rates are the nearest to the targets of
    the clean domain's scale. So rates are defined for any weights and
    probabilities; ``mix_report`` says what was missed. Without tokens, or without
    a wanted domain that has any, all rates are 1.

    Runs at once, some ten passes, at most ``MOST_PASSES``: store ``posteriors``.
    """
    domains = list(weights)
    n = len(domains)
    first = [F.sum(F.col("tokens") * F.col(f"p_{d}")) for d in domains]
    moments = [
        F.sum(F.col("tokens") * F.col(f"p_{domains[a]}") * F.col(f"p_{domains[b]}"))
        for a in range(n) for b in range(a, n)
    ]
    row = np.array([float(x or 0) for x in posteriors.agg(*first, *moments).first()])
    has, all_ = row[:n], _symmetric(row[n:], n)
    wanted = np.array([float(weights[d]) for d in domains])
    present = [i for i in range(n) if wanted[i] > 0 and has[i] > NEGLIGIBLE * has.sum()]
    if not present:
        return posteriors.withColumn("rate", F.lit(1.0))
    targets = Targets(domains, has, all_, wanted, max(present, key=lambda i: wanted[i]), most)
    metric = np.linalg.pinv(all_, rcond=1e-9, hermitian=True)
    limited = posteriors.withColumn("limit", targets.limit())
    made: list[np.ndarray] = []

    def miss(expected: np.ndarray, scale: float) -> float:
        error = expected - targets.at(scale)
        return float(error @ metric @ error)

    def best_scale(expected: np.ndarray) -> float:
        low, high = LEAST_SCALE * targets.scale, targets.scale
        while high - low > 1e-12 * targets.scale:
            third = (high - low) / 3
            if miss(expected, low + third) < miss(expected, high - third):
                high -= third
            else:
                low += third
        return (low + high) / 2

    scale, now, at_clean_scale = targets.scale, _Tried(has, all_), None
    for passes in range(MOST_PASSES):
        error = now.expected - targets.at(scale)
        unmet = np.abs(error).max() / targets.at(scale).sum()
        if unmet < CLOSE:
            break
        by_all = metric @ error
        by_free = np.linalg.solve(now.free + 1e-6 * all_ + 1e-12 * has.sum() * np.eye(n), error)
        steps = [x * by_all for x in TRIED_ALL] + [x * by_free for x in TRIED_FREE]
        tried = _try(limited, domains, made, steps)
        scales = [scale if at_clean_scale is None else best_scale(t.expected) for t in tried]
        best = min(range(len(steps)), key=lambda j: miss(tried[j].expected, scales[j]))
        before, after = miss(now.expected, scale), miss(tried[best].expected, scales[best])
        if before <= 1e-15 * has.sum():
            # What is missed lies where no rates can reach.
            at_clean_scale = made if at_clean_scale is None else at_clean_scale
            break
        if after >= before and at_clean_scale is not None:
            break
        made = [*made, steps[best]]
        now, scale = tried[best], scales[best]
        if at_clean_scale is None and after > before / 2 and passes >= 2:
            at_clean_scale = made
        elif at_clean_scale is not None and after > before * (1 - 1e-4):
            break
    unmet = np.abs(now.expected - targets.at(scale)).max() / targets.at(scale).sum()
    if unmet > UNMET and at_clean_scale is not None:
        made = at_clean_scale
    return limited.withColumn("rate", _rate(domains, made)).drop("limit")


def mix_report(rated: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """One row per domain: weight, tokens that it has, that are wanted beside what
    the clean domain keeps, and that the rates keep, and the share of all kept ones.

    The clean domain is the one of ``document_rates``. Wanted tokens are null
    where no domain with a weight has tokens, shares where nothing is kept.
    """
    domains, sums = list(weights), []
    for i, d in enumerate(domains):
        tokens = F.col("tokens") * F.col(f"p_{d}")
        sums += [F.coalesce(F.sum(tokens), F.lit(0.0)).alias(f"has_{i}")]
        sums += [F.coalesce(F.sum(F.col("rate") * tokens), F.lit(0.0)).alias(f"kept_{i}")]
    row = rated.agg(*sums).first()
    has, kept = ([float(row[f"{x}_{i}"]) for i in range(len(domains))] for x in ("has", "kept"))
    present = [i for i, d in enumerate(domains) if weights[d] > 0 and has[i] > NEGLIGIBLE * sum(has)]
    clean = max(present, key=lambda i: weights[domains[i]], default=None)
    unit = None if clean is None else kept[clean] / weights[domains[clean]]
    rows = [
        (d, float(weights[d]), has[i], None if unit is None else unit * weights[d], kept[i], kept[i] / sum(kept) if sum(kept) else None)
        for i, d in enumerate(domains)
    ]
    # One row per domain.
    return rated.sparkSession.createDataFrame(
        rows, "domain string, weight double, has_tokens double, wanted_tokens double, kept_tokens double, kept_share double"
    )


def copies(rate: Column, doc_id: Column, seed: int = 0) -> Column:
    """How often a document is taken: the rate, rounded by the document's hash."""
    uniform = F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 32)) / float(1 << 32)
    return F.floor(rate + uniform).cast("int")


def mix_domains(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """One row per document: doc_id, tokens, p_<domain>, rate, copies.

    Null and empty texts have no tokens and the probabilities of an empty text.
    Columns other than doc_id and text are not read. Rows that repeat an id are
    taken alike. If the labels are of less than two domains, or of other
    documents, nothing tells domains apart: every document is taken once.
    """
    model = fit_domains(docs, labelled, list(weights))
    found = stored(domain_posteriors(docs, model))
    rates = document_rates(found, weights) if model.tells else found.withColumn("rate", F.lit(1.0))
    return rates.withColumn("copies", copies(F.col("rate"), F.col("doc_id")))


def mixed_documents(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """The documents, each as often as ``mix_domains`` says; all columns stay.

    Of the rates of a repeated id the largest counts; rows with a null id stay.
    """
    name = free_name(docs, "copies")
    rates = mix_domains(docs, labelled, weights).where(F.col("doc_id").isNotNull())
    rates = rates.groupBy("doc_id").agg(F.max("copies").alias(name))
    times = F.when(F.col("doc_id").isNull(), 1).otherwise(F.coalesce(F.col(name), F.lit(0)))
    taken = docs.join(rates, "doc_id", "left").withColumn(name, times).where(F.col(name) > 0)
    again = taken.withColumn(name, F.explode(F.sequence(F.lit(1), F.col(name))))
    return again.select(*docs.columns)
