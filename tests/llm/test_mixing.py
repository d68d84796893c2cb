from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientela.llm import mixing
from clientela.llm.mixing import document_rates, mix_domains, mix_report, mixed_documents
from clientela.llm.queries import WEIGHTS, domain_labels
from clientela.sources.scratch import stored


def frame_of(spark, p, tokens):
    names = ["p_good", "p_poor", "p_toxic"][: p.shape[1]]
    rows = [(i, int(t), *map(float, row)) for i, (t, row) in enumerate(zip(tokens, p))]
    return stored(spark.createDataFrame(rows, "doc_id long, tokens long, " + ", ".join(f"{n} double" for n in names)))


def rates_of(frame, weights=WEIGHTS, **options):
    rows = document_rates(frame, weights, **options).orderBy("doc_id").collect()
    return np.array([r["rate"] for r in rows])


def literal_rates(p, tokens, weights, most=4.0):
    """Plain projected gradient on the same least squares, to the clean domain's
    scale, a hundred thousand short steps."""
    w, has = np.array(list(weights.values())), tokens @ p
    clean = w.argmax()
    scale = has[clean] / w[clean]
    limit = 1 + (most - 1) * p[:, has < scale * w].sum(axis=1)
    target = np.minimum(scale * w, has + 0.98 * (limit * tokens - tokens) @ p)
    metric = np.linalg.pinv((p * tokens[:, None]).T @ p, hermitian=True)
    rate = np.ones(len(p))
    for _ in range(100_000):
        error = (rate * tokens) @ p - target
        if np.abs(error).max() < 1e-7 * target.sum():
            break
        rate = np.clip(rate - p @ (metric @ error), 0, limit)
    return (rate * tokens) @ p, target, limit


@pytest.mark.parametrize("seed,alpha,weights", [
    (1, [0.3, 0.2, 0.1], (0.5, 0.3, 0.2)), (2, [0.05, 0.008, 0.008], (0.5, 0.3, 0.2)), (3, [3, 1, 1], (0.6, 0.2, 0.2)),
])
def test_totals_equal_projected_gradient_in_numpy(spark, seed, alpha, weights):
    generator = np.random.default_rng(seed)
    p, tokens = generator.dirichlet(alpha, 600), generator.integers(0, 400, 600)
    weights = dict(zip(WEIGHTS, weights))
    want, target, limit = literal_rates(p, tokens, weights)
    rate = rates_of(frame_of(spark, p, tokens), weights)
    assert (rate >= 0).all() and (rate <= limit + 1e-9).all()
    assert np.abs((rate * tokens) @ p - want).max() < 1e-3 * target.sum()
    assert np.abs(want - target).max() < 1e-3 * target.sum()


@pytest.mark.parametrize("alpha,weights", [
    ([2, 1.5, 1], (0.9, 0.07, 0.03)), ([2, 1.5, 1], (0.5, 0.3, 0.2)), ([0.3, 0.2, 0.1], (0.05, 0.05, 0.9)), ([6, 0.5, 0.4], (0.9, 0.07, 0.03)),
])
def test_overlapping_domains_meet_their_shares(spark, alpha, weights):
    generator = np.random.default_rng(3)
    p, tokens = generator.dirichlet(alpha, 5000), generator.integers(0, 400, 5000)
    rate = rates_of(frame_of(spark, p, tokens), dict(zip(WEIGHTS, weights)))
    assert rate.min() >= 0 and rate.max() <= 1 + 1e-9
    totals = (rate * tokens) @ p
    assert np.abs(totals / totals.sum() - weights).max() < 1e-3


@pytest.mark.parametrize("p", [[0.3, 0.5, 0.2], [1 / 3] * 3, [0.0, 0.5, 0.5], [1.0, 0.0, 0.0]])
def test_weights_out_of_reach_give_rates_and_a_report(spark, p):
    frame = frame_of(spark, np.tile(p, (50, 1)), np.full(50, 10))
    rate = rates_of(frame)
    assert np.isfinite(rate).all() and (rate >= 0).all() and rate.max() > 0.05
    report = {r["domain"]: r for r in mix_report(document_rates(frame, WEIGHTS), WEIGHTS).collect()}
    assert [report[d]["has_tokens"] for d in WEIGHTS] == pytest.approx([500 * x for x in p])
    assert sum(r["kept_share"] for r in report.values()) == pytest.approx(1)


def test_no_tokens_and_no_documents(spark):
    frame = frame_of(spark, np.tile([0.2, 0.3, 0.5], (5, 1)), np.zeros(5))
    assert set(rates_of(frame)) == {1.0}
    assert document_rates(frame.where("false"), WEIGHTS).count() == 0
    report = mix_report(document_rates(frame, WEIGHTS), WEIGHTS).collect()
    assert {(r["kept_tokens"], r["wanted_tokens"], r["kept_share"]) for r in report} == {(0.0, None, None)}


def labels(spark, docs):
    rows = [(r["doc_id"], "good" if i % 2 else "poor") for i, r in enumerate(docs.collect())]
    return spark.createDataFrame([*rows, (1, "good"), (None, "good"), (5, None), (77, "poor")], "doc_id long, domain string")


@pytest.mark.parametrize("frame", ["odd", "clashing", "empty"])
def test_odd_rows(request, spark, frame):
    docs = request.getfixturevalue(frame)
    rows = mix_domains(docs, labels(spark, docs), WEIGHTS).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert abs(r["p_good"] + r["p_poor"] + r["p_toxic"] - 1) < 1e-9
        assert 0 <= r["rate"] <= mixing.MOST_RATE and abs(r["copies"] - r["rate"]) <= 1
    assert mixed_documents(docs, labels(spark, docs), WEIGHTS).columns == docs.columns


def test_without_labels_all_are_alike(make):
    docs = make([(i, f"some words {i}") for i in range(20)])
    none = docs.select("doc_id", F.lit(None).cast("string").alias("domain"))
    rows = mix_domains(docs, none, {"a": 1.0, "b": 1.0}).collect()
    assert {(r["p_a"], r["rate"]) for r in rows} == {(0.5, 1.0)}


@pytest.mark.parametrize("labelled", ["none", "other documents", "one each", "one domain"])
def test_poor_labels_give_rates(spark, make, labelled):
    docs = make([(i, f"some plain words {i} " + ("#buy $now " * 9 if i % 3 == 0 else "")) for i in range(60)])
    rows = {
        "none": [], "other documents": [(1000 + i, "good") for i in range(9)] + [(2000, "poor")],
        "one each": [(1, "good"), (3, "poor"), (6, "toxic")], "one domain": [(1, "poor"), (2, "poor")],
    }[labelled]
    given = spark.createDataFrame(rows, "doc_id long, domain string")
    found = mix_domains(docs, given, WEIGHTS).collect()
    assert len(found) == 60 and all(np.isfinite(r["rate"]) and r["rate"] >= 0 for r in found)
    if labelled != "one each":
        assert {(r["rate"], r["copies"]) for r in found} == {(1.0, 1)}
    assert mixed_documents(docs, given, WEIGHTS).count() == sum(r["copies"] for r in found) > 0


def test_targets_are_met_and_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labelled = domain_labels(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    rates = mix_domains(docs, labelled, WEIGHTS).cache()
    total = F.sum(F.col("rate") * F.col("tokens"))
    for domain, weight in WEIGHTS.items():
        share = rates.agg(F.sum(F.col("rate") * F.col("tokens") * F.col(f"p_{domain}")) / total).first()[0]
        assert abs(share - weight) < 1e-4
    found = rates.join(labelled, "doc_id").groupBy("domain").agg(F.avg("copies").alias("n"))
    mean = {r["domain"]: r["n"] for r in found.collect()}
    assert mean["good"] > 0.98 and mean["poor"] < 0.7 and mean["toxic"] < 0.7
    assert rates.agg(F.max("copies")).first()[0] == 1
    # A document stays as often as its rate says.
    sums = rates.agg(F.sum("copies"), F.sum("rate")).first()
    assert abs(sums[0] / sums[1] - 1) < 0.05


def test_copies_are_rows(spark, make):
    docs = make([(i, "the same words here") for i in range(400)] + [(None, "x")])
    none = docs.select("doc_id", F.lit("a").alias("domain"))
    rows = mixed_documents(docs, none, {"a": 1.0}).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in rows) == [-1, *range(400)]


@pytest.mark.parametrize("rare", [0, 1, 10])
def test_clean_documents_stay_where_a_domain_is_rare(make, rare):
    texts = ["plain words about some matter %d" % i for i in range(800)]
    texts += ["#buy $cheap *deal* |now| <click>" for _ in range(200 - rare)] + ["vile foul nasty words"] * rare
    docs = make(list(enumerate(texts)))
    domain = F.when(F.col("doc_id") < 800, "good").when(F.col("doc_id") < 1000 - rare, "poor").otherwise("toxic")
    labelled = docs.select("doc_id", domain.alias("domain"))
    rows = mix_domains(docs, labelled, WEIGHTS).collect()
    rate = np.array([r["rate"] for r in sorted(rows, key=lambda r: r["doc_id"])])
    assert rate[:800].mean() > 0.98 and rate[800 : 1000 - rare].mean() < 0.7
    assert rate[: 1000 - rare].max() < 1.05 and (not rare or rate[1000 - rare :].mean() > 0.9)


def test_scarce_domains_are_repeated_up_to_the_limit_and_reported(spark):
    p = np.array([[0.999, 0.001]] * 980 + [[0.01, 0.99]] * 20)
    frame = frame_of(spark, p, np.full(1000, 100))
    weights = {"good": 0.9, "poor": 0.1}
    for most, reached in ((10.0, 0.1), (2.0, None), (1.0, None)):
        rated = document_rates(frame, weights, most).cache()
        rate = np.array([r["rate"] for r in rated.orderBy("doc_id").collect()])
        assert rate[:980].min() > 0.98 and rate[:980].max() < 1.02 and rate.max() <= most + 1e-9
        report = {r["domain"]: r for r in mix_report(rated, weights).collect()}
        if reached:
            assert report["poor"]["kept_share"] == pytest.approx(reached, abs=1e-3)
        else:
            assert rate[980:].mean() > 0.97 * most
            assert report["poor"]["kept_tokens"] < 0.5 * report["poor"]["wanted_tokens"]


def test_a_wide_vocabulary_tells_rare_domains(make):
    """Toxic texts of 60 kinds of words, beside poor ones with more frequent words."""
    filler = "some plain words about the matter"
    texts = [f"{filler} bad{i % 20}a bad{i % 20}b" for i in range(600)]
    texts += [f"{filler} vile{i % 60}x" for i in range(900)] + [f"{filler} fine{i % 7}y" for i in range(4500)]
    docs = make(list(enumerate(texts)))
    domain = F.when(F.col("doc_id") < 600, "poor").when(F.col("doc_id") < 1500, "toxic").otherwise("good")
    labelled = docs.select("doc_id", domain.alias("domain"))
    model = mixing.fit_domains(docs, labelled, list(WEIGHTS))
    rows = mixing.domain_posteriors(docs, model).select("doc_id", "p_toxic", "p_poor").collect()
    for r in rows:
        assert (r["p_toxic"] > 0.5) == (600 <= r["doc_id"] < 1500) and (r["p_poor"] > 0.5) == (r["doc_id"] < 600)
