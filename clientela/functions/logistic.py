"""Logistic regressions by Newton's method on sums over the data.

Every step is one aggregation: the tasks sum the loss, its gradient and its
matrix of second derivatives, which for d features are 1 + (d + 1) + (d + 1) *
(d + 2) / 2 numbers, and the driver solves for the next weights. Several
regressions on parts of the same rows take their steps in the same pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

RIDGE = 0.01
# Newton stops when no weight of a standardised feature moves by more than this.
CLOSE = 1e-9
MOST_PASSES = 100


@dataclass(frozen=True)
class Logistic:
    """A fitted regression.

    ``weights`` belong to (feature - mean) / scale. Where the rows have one label
    only, no finite weights are best: the probability is then ``constant``, that
    label's, and null where there are no rows.
    """

    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    intercept: float = 0.0
    weights: tuple[float, ...] = ()
    constant: float | None = None
    fitted: bool = False

    def probability(self, features: Sequence[Column]) -> Column:
        """Of the label being true; null where a feature is."""
        if not self.fitted:
            return F.lit(self.constant).cast("double")
        z = F.lit(self.intercept)
        for x, m, s, w in zip(features, self.mean, self.scale, self.weights, strict=True):
            z = z + F.lit(w) * ((x.cast("double") - F.lit(m)) / F.lit(s))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


@dataclass
class _Search:
    """Where a fit stands: the best weights so far and the step tried from there."""

    rows: int
    mean: list[float]
    scale: list[float]
    best: np.ndarray
    step: np.ndarray
    loss: float = float("inf")
    done: bool = False
    tried: np.ndarray = field(default_factory=lambda: np.zeros(0))


def fit_logistics(
    rows: DataFrame,
    label: Column,
    features: Sequence[Column],
    members: Mapping[str, Column],
    ridge: float = RIDGE,
) -> dict[str, Logistic]:
    """One regression of the boolean ``label`` per entry of ``members``, a condition on rows.

    Minimises the mean log loss of the member rows plus ``ridge`` / 2 times the
    squared weights of the standardised features (population mean and standard
    deviation; the intercept is free). With a ridge the minimum is finite and
    unique even if a feature separates the labels; a feature of one value has the
    weight 0. A step that does not lower the objective is halved. Rows with a null
    label, feature or condition belong to no regression.

    Runs at once, one pass for the scales and one per step: store ``rows``.
    """
    if ridge <= 0:
        raise ValueError("without a ridge the weights of separable labels are infinite")
    names = list(members)
    known = label.isNotNull()
    for x in features:
        known = known & x.isNotNull()
    data = rows.where(known).select(
        label.cast("double").alias("y"),
        *(x.cast("double").alias(f"x{j}") for j, x in enumerate(features)),
        *(F.coalesce(members[name], F.lit(False)).alias(f"in{k}") for k, name in enumerate(names)),
    )
    size = len(features)

    def per_member(k: int) -> list[Column]:
        inside = F.col(f"in{k}")
        parts = [F.count_if(inside).alias(f"n{k}"), F.count_if(inside & (F.col("y") > 0)).alias(f"c{k}")]
        for j in range(size):
            x = F.when(inside, F.col(f"x{j}"))
            parts += [F.avg(x).alias(f"m{k}_{j}"), F.stddev_pop(x).alias(f"s{k}_{j}")]
        return parts

    totals = data.agg(*(c for k in range(len(names)) for c in per_member(k))).first()
    fitted: dict[str, Logistic] = {}
    searches: dict[int, _Search] = {}
    for k, name in enumerate(names):
        n, positive = totals[f"n{k}"], totals[f"c{k}"]
        if positive in (0, n):
            fitted[name] = Logistic(constant=positive / n if n else None)
            continue
        scale = [totals[f"s{k}_{j}"] or 1.0 for j in range(size)]
        searches[k] = _Search(n, [totals[f"m{k}_{j}"] for j in range(size)], scale, np.zeros(size + 1), np.zeros(size + 1))

    for _ in range(MOST_PASSES):
        open_ = {k: s for k, s in searches.items() if not s.done}
        if not open_:
            break
        for s in open_.values():
            s.tried = s.best + s.step
        for k, (loss, gradient, matrix) in _sums(data, size, open_).items():
            s = open_[k]
            penalty = np.append(0.0, np.full(size, ridge))
            objective = loss / s.rows + (penalty * s.tried**2).sum() / 2
            if objective > s.loss + 1e-12 * abs(s.loss):
                s.step = s.step / 2
                s.done = bool(np.abs(s.step).max() < CLOSE)
                continue
            s.best, s.loss = s.tried, objective
            s.step = -np.linalg.solve(matrix / s.rows + np.diag(penalty), gradient / s.rows + penalty * s.best)
            if np.abs(s.step).max() < CLOSE:
                s.best, s.done = s.best + s.step, True
    for k, s in searches.items():
        if not s.done:
            raise ArithmeticError(f"the regression {names[k]!r} did not settle in {MOST_PASSES} passes")
        w = s.best.tolist()
        fitted[names[k]] = Logistic(tuple(s.mean), tuple(s.scale), w[0], tuple(w[1:]), fitted=True)
    return fitted


def _sums(data: DataFrame, size: int, searches: Mapping[int, _Search]) -> dict[int, tuple]:
    """Loss, gradient and second derivatives at the tried weights of each search."""
    # Margins, probabilities and products in stages, so that each is computed once.
    scaled = {f"x{k}_{j}": (F.col(f"x{j}") - s.mean[j]) / s.scale[j] for k, s in searches.items() for j in range(size)}
    margins = {}
    for k, s in searches.items():
        z = F.lit(float(s.tried[0]))
        for j in range(size):
            z = z + F.lit(float(s.tried[j + 1])) * F.col(f"x{k}_{j}")
        margins[f"z{k}"] = z
    at = data.withColumns(scaled).withColumns(margins)
    at = at.withColumns({f"p{k}": F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(f"z{k}"))) for k in searches})
    parts = []
    for k in searches:
        inside = F.col(f"in{k}")
        z, p = F.col(f"z{k}"), F.col(f"p{k}")
        xs = [F.lit(1.0), *(F.col(f"x{k}_{j}") for j in range(size))]

        def total(value: Column, name: str, inside: Column = inside) -> None:
            parts.append(F.sum(F.when(inside, value).otherwise(0.0)).alias(name))

        total(F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - F.col("y") * z, f"l{k}")
        for i, x in enumerate(xs):
            total((p - F.col("y")) * x, f"g{k}_{i}")
            for j in range(i, size + 1):
                total(p * (F.lit(1.0) - p) * x * xs[j], f"h{k}_{i}_{j}")
    row = at.agg(*parts).first()
    sums = {}
    for k in searches:
        gradient = np.array([row[f"g{k}_{i}"] for i in range(size + 1)])
        matrix = np.array([[row[f"h{k}_{min(i, j)}_{max(i, j)}"] for j in range(size + 1)] for i in range(size + 1)])
        sums[k] = row[f"l{k}"], gradient, matrix
    return sums
