"""Regressions by Newton steps against minimising the same objective in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientela.functions import logistic
from clientela.operators import churn


def _objective(x, y, ridge):
    """Weights by plain gradient descent with halving steps, for comparison."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    design = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    penalty = np.array([0.0] + [ridge] * x.shape[1])
    w = np.zeros(design.shape[1])
    for _ in range(40_000):
        p = 1 / (1 + np.exp(-design @ w))
        gradient = design.T @ (p - y) / len(y) + penalty * w
        w = w - 1.5 * gradient
        if np.abs(gradient).max() < 1e-11:
            break
    return 1 / (1 + np.exp(-design @ w))


def _frame(spark, x, y, extra=()):
    rows = [(i, *map(float, v), bool(t)) for i, (v, t) in enumerate(zip(x, y))] + list(extra)
    schema = "i bigint, " + ", ".join(f"f{j} double" for j in range(x.shape[1])) + ", label boolean"
    return spark.createDataFrame(rows, schema).repartition(4)


def _fit(frame, size, members=None, **options):
    features = [F.col(f"f{j}") for j in range(size)]
    return logistic.fit_logistics(frame, F.col("label"), features, members or {"all": F.lit(True)}, **options), features


@pytest.mark.parametrize("seed,ridge", [(0, 0.01), (1, 0.3), (2, 1e-3)])
def test_against_gradient_descent(spark, seed, ridge):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, [1, 50, 0.01], (300, 3)) + [0, 900, 3]
    y = rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] + (x[:, 1] - 900) / 40)))
    frame = _frame(spark, x, y, [(-1, None, 1.0, 1.0, True), (-2, 1.0, 1.0, 1.0, None)])
    models, features = _fit(frame, 3, ridge=ridge)
    rows = frame.where("i >= 0").select("i", models["all"].probability(features).alias("p")).orderBy("i").collect()
    assert np.array([r.p for r in rows]) == pytest.approx(_objective(x, y, ridge), abs=1e-7)
    assert frame.where("i = -1").select(models["all"].probability(features)).first()[0] is None


def test_several_at_once_equal_one_at_a_time(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (200, 2))
    frame = _frame(spark, x, rng.random(200) < 0.3 + 0.3 * (x[:, 0] > 0))
    members = {str(k): F.col("i") % 3 != k for k in range(3)}
    together, _ = _fit(frame, 2, members)
    for name, condition in members.items():
        alone, _ = _fit(frame.where(condition), 2)
        assert together[name].intercept == pytest.approx(alone["all"].intercept, abs=1e-9)
        assert together[name].weights == pytest.approx(alone["all"].weights, abs=1e-9)


def test_separable_labels_have_finite_weights(spark):
    x = np.arange(40, dtype=float)[:, None]
    frame = _frame(spark, x, x[:, 0] > 30)
    models, features = _fit(frame, 1, ridge=1e-4)
    weights = models["all"].weights
    assert np.isfinite(weights).all() and weights[0] > 5
    scored = frame.select("label", models["all"].probability(features).alias("p")).collect()
    assert max(r.p for r in scored if not r.label) < min(r.p for r in scored if r.label)
    with pytest.raises(ValueError):
        _fit(frame, 1, ridge=0)


def test_a_step_too_far_is_halved(spark, monkeypatch):
    """Rare labels far out let plain Newton steps overshoot; the fit still settles."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, 400), [400.0, 500.0]])[:, None]
    y = np.concatenate([np.zeros(400, bool), [True, True]])
    y[:3] = True
    frame = _frame(spark, x, y)
    models, features = _fit(frame, 1, ridge=1e-5)
    p = np.array([r.p for r in frame.select("i", models["all"].probability(features).alias("p")).orderBy("i").collect()])
    mean, scale = x.mean(), x.std()
    design = np.column_stack([np.ones(len(x)), (x[:, 0] - mean) / scale])
    w = np.array([models["all"].intercept, models["all"].weights[0]])
    gradient = design.T @ (p - y) / len(y) + np.array([0, 1e-5]) * w
    assert np.abs(gradient).max() < 1e-8


def test_one_kind_of_label_no_rows_and_one_value(spark):
    x = np.ones((20, 1))
    for label, want in ((True, 1.0), (False, 0.0)):
        models, features = _fit(_frame(spark, x, np.full(20, label)), 1)
        assert spark.range(1).select(models["all"].probability([F.lit(1.0)])).first()[0] == want
    models, _ = _fit(_frame(spark, x, np.full(20, True)).where("false"), 1)
    assert spark.range(1).select(models["all"].probability([F.lit(1.0)])).first()[0] is None
    models, _ = _fit(_frame(spark, x, np.arange(20) < 5), 1)
    assert models["all"].weights == (0.0,)
    assert spark.range(1).select(models["all"].probability([F.lit(9.0)])).first()[0] == pytest.approx(0.25)


def test_churn_quality_of_one_kind_of_label(spark):
    rows = [(i, None, i, 1, 5.0, True) for i in range(30)]
    labels = spark.createDataFrame(
        rows, "ID_CLI bigint, LAST_DATE date, RECENCY int, FREQUENCY bigint, MONETARY double, CHURNED boolean"
    )
    assert {r.AUC for r in churn.model_quality(labels).collect()} == {None}
    scores = churn.model_scores(churn.churn_model(labels), labels)
    assert {r.CHURN_PROBABILITY for r in scores.collect()} == {1.0}


def test_one_aggregation_a_step(spark):
    """No rows leave the tasks, whatever their number."""
    frame = spark.range(0, 50_000, 1, 16).selectExpr("id AS i", "id % 97 / 10 AS f0", "id % 5 = 0 AS label")
    models, _ = _fit(frame, 1)
    assert models["all"].fitted and abs(models["all"].intercept + np.log(4)) < 0.01
