"""Exact quantiles, profiles and top levels against numpy and Python."""

from collections import Counter
from datetime import date

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings as fast, strategies as st
from pyspark.sql import functions as F

from clientela.functions.quantiles import exact_quantiles
from clientela.operators.intervals import gap_quantile
from clientela.operators.quality import profile, top_levels

PROBS = (0.0, 0.1, 0.25, 0.5, 0.8, 0.9, 1.0)


def _check(spark, groups, block, most=100):
    size = max(map(len, groups.values()))
    padded = [[None if v is None else float(v) for v in x] + [None] * (size - len(x)) for x in groups.values()]
    df = spark.createDataFrame(list(zip(*padded)), ", ".join(f"{name} double" for name in groups))
    got = exact_quantiles(df, {name: F.col(name) for name in groups}, PROBS, block, most)
    for name, values in groups.items():
        known = [v for v in values if v is not None]
        assert got[name].count == len(known)
        if not known:
            assert got[name].mean is None and got[name].quantiles == [None] * len(PROBS)
            continue
        assert got[name].mean == pytest.approx(np.mean(known), rel=1e-9, abs=1e-6)
        assert got[name].quantiles == pytest.approx(np.quantile(known, PROBS), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("block,most", [(2, 3), (3, 1), (16, 100)])
def test_columns_of_different_shape(spark, block, most):
    rng = np.random.default_rng(1)
    _check(
        spark,
        {
            "one": [3.5],
            "two": [1, 2],
            "hot": [5] * 400 + [1, 9],
            "hot_low": [1] * 500 + list(range(2, 90)),
            "ids": list(range(1000)),
            "money": list(rng.lognormal(8, 2, 700).round(2)),
            "nulls": [None, 4, None, 2, 2],
            "nothing": [None, None],
            "negative": list(rng.normal(0, 1e9, 300)),
            "close": list(1 + rng.integers(0, 40, 300) * 2.0**-52),
        },
        block,
        most,
    )


@fast(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=40), st.integers(2, 5), st.integers(1, 9))
def test_small_lists(spark, values, block, most):
    _check(spark, {"x": values}, block, most)


def test_quantile_of_gaps_interpolates(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1, 2, 2, 5, 9, 40])], "ID_CLI int, Max int")
    row = gap_quantile(df).first()
    assert (row.DAYS, row.CUSTOMERS) == (24.5, 6)


def test_profile(spark):
    rows = [(1, "a", date(1970, 1, 3), True), (4, None, None, False), (10, "b", date(1970, 1, 5), True),
            (None, "a", date(1970, 1, 4), None)]
    out = profile(spark.createDataFrame(rows, "n bigint, s string, d date, b boolean"))
    got = {r.COLUMN: tuple(r)[1:] for r in out.collect()}
    assert got["n"] == ("bigint", 4, 1, 1.0, 2.5, 4.0, 5.0, 7.0, 10.0)
    assert got["s"] == ("string", 4, 1, None, None, None, None, None, None)
    assert got["d"] == ("date", 4, 1, 2.0, 2.5, 3.0, 3.0, 3.5, 4.0)
    assert got["b"][:3] == ("boolean", 4, 1) and got["b"][6] == pytest.approx(2 / 3)


def test_profile_of_timestamps_and_empty_columns(spark):
    df = spark.sql(
        "select timestamp_ntz'1970-01-01 00:01:00' as t, cast(null as int) as nothing, 'x' as s"
    )
    got = {r.COLUMN: r for r in profile(df).collect()}
    assert got["t"].MEDIAN == 60.0
    assert (got["nothing"].N_MISSING, got["nothing"].MIN) == (1, None)


def test_profile_of_text_alone(spark):
    got = profile(spark.createDataFrame([("a",), (None,)], "s string")).collect()
    assert [tuple(r) for r in got] == [("s", "string", 2, 1, None, None, None, None, None, None)]


def test_top_levels(spark):
    values = ["a"] * 5 + ["b"] * 5 + ["c"] * 3 + ["d"] * 2 + ["e"] + [None] * 4
    df = spark.createDataFrame([(v, "k") for v in values], "x string, y string")
    got = {(r.COLUMN, r.LEVEL): r.N for r in top_levels(df, ["x", "y"], k=3).collect()}
    assert got == {
        ("x", "a"): 5, ("x", "b"): 5, ("x", "c"): 3, ("x", "(Other)"): 3, ("x", None): 4, ("y", "k"): 20,
    }
    assert sum(n for (c, _), n in got.items() if c == "x") == sum(Counter(values).values())
