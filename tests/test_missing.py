"""Missing values as values: distinct counts, extremes, choices, joins."""

from pyspark.sql import functions as F

from clientela.functions.missing import choose, n_distinct, strict_max, strict_min, tokens_to_null
from clientela.operators.joins import null_safe_join
from clientela.operators.quality import key_audit

from helpers import sorted_rows


def test_n_distinct_counts_null_once(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",), (None,)], "k string")
    assert df.agg(n_distinct("k")).first()[0] == 2
    assert df.where("k is not null").agg(n_distinct("k")).first()[0] == 1
    assert df.where("false").agg(n_distinct("k")).first()[0] == 0


def test_n_distinct_per_group(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b"), (2, "b")], "g int, k string")
    assert sorted_rows(df.groupBy("g").agg(n_distinct("k").alias("n"))) == [(1, 2), (2, 1)]


def test_strict_extremes_are_null_with_a_null(spark):
    df = spark.createDataFrame([(1, 5), (1, None), (2, 3), (2, 7)], "g int, x int")
    out = df.groupBy("g").agg(strict_min("x").alias("lo"), strict_max("x").alias("hi"))
    assert sorted_rows(out.select("g", "hi", "lo")) == [(1, None, None), (2, 7, 3)]


def test_choose_keeps_an_unknown_condition_unknown(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "c boolean")
    out = df.select(choose(F.col("c"), F.lit("yes"), F.lit("no")).alias("x"))
    assert [r[0] for r in out.collect()] == ["yes", "no", None]


def test_tokens_to_null_only_touches_text(spark):
    df = spark.createDataFrame([("NA", "", 1), ("x", None, 2)], "a string, b string, n int")
    assert [tuple(r) for r in tokens_to_null(df, ("NA", "")).collect()] == [
        (None, None, 1),
        ("x", None, 2),
    ]
    assert [tuple(r) for r in tokens_to_null(df, ("",)).collect()] == [("NA", None, 1), ("x", None, 2)]


def test_null_safe_join_matches_nulls(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k bigint, a string")
    b = spark.createDataFrame([(2, "p"), (None, "q")], "k bigint, b string")
    left = null_safe_join(a, b, ["k"], "left")
    assert sorted_rows(left.select("k", "a", "b").toDF("c1", "c2", "c3")) == [
        (None, "y", "q"),
        (1, "x", None),
    ]
    full = null_safe_join(a, b, ["k"], "full")
    assert sorted_rows(full.toDF("c1", "c2", "c3")) == [
        (None, "y", "q"), (1, "x", None), (2, None, "p"),
    ]
    inner = null_safe_join(a, b, ["k"], "inner")
    assert sorted_rows(inner.toDF("c1", "c2", "c3")) == [(None, "y", "q")]


def test_null_safe_join_on_several_keys(spark):
    a = spark.createDataFrame([(1, None, "x"), (1, 2, "y")], "k bigint, m bigint, a string")
    b = spark.createDataFrame([(1, None, "p")], "k bigint, m bigint, b string")
    out = null_safe_join(a, b, ["k", "m"])
    assert {(r.k, r.m, r.a, r.b) for r in out.collect()} == {(1, None, "x", "p"), (1, 2, "y", None)}


def test_key_audit_counts_null_as_a_key_of_both(spark):
    a = spark.createDataFrame([(1,), (1,), (None,)], "k bigint")
    b = spark.createDataFrame([(2,), (None,), (None,)], "k bigint")
    out = key_audit(a, b, "k", "in_a", "in_b", "n")
    assert {(r.in_a, r.in_b): r.n for r in out.collect()} == {
        (1, 1): 1, (1, None): 1, (None, 1): 1,
    }
