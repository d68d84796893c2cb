"""Top rows per group, targets, the funnel in one table and single files, against Python."""

import random

import pytest
from pyspark.sql import functions as F

from clientela.functions.ranking import top_per_group
from clientela.operators import churn, distributions, summary
from clientela.operators.events import type_events
from clientela.operators.funnel import email_funnel
from clientela.sources.delimited import read_csv, write_csv_file

from helpers import campaign_frame, event_frame, plan, sorted_rows


def _top(rows, k):
    result = []
    for group in {g for g, _, _ in rows}:
        mine = sorted((r for r in rows if r[0] == group and r[1] is not None), key=lambda r: (-r[1], r[2]))
        result += [(*r, n) for n, r in enumerate(mine[:k], 1)]
    return sorted(result, key=str)


SCORES = {
    "spread": lambda rng: rng.lognormvariate(0, 3),
    "ties": lambda rng: rng.choice([0.0, 1.0, 2.0]),
    "close": lambda rng: 1 + rng.randrange(5) * 2.0**-52,
    "signs": lambda rng: rng.choice([None, -1.5, 0.0, -1e300, 1e-320, 1e300, rng.gauss(0, 1)]),
}


@pytest.mark.parametrize("kind", SCORES)
@pytest.mark.parametrize("k", [1, 7, 5000])
def test_top_per_group(spark, kind, k):
    rng = random.Random(k)
    rows = [(rng.choice(["a", "a", "a", "b", None]), SCORES[kind](rng), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, s double, i int").repartition(5)
    assert sorted(map(tuple, top_per_group(df, "g", "s", "i", k).collect()), key=str) == _top(rows, k)


def test_rows_below_the_bound_are_not_ranked(spark):
    df = spark.range(0, 100_000, 1, 8).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("s"), "id")
    top = top_per_group(df, "g", "s", "id", 10)
    assert sorted(r.id for r in top.collect()) == list(range(99_970, 100_000))
    text = plan(top)
    assert "WindowGroupLimit" in text
    bound = text.index("_least")
    assert text.index("WindowGroupLimit") < bound


def test_targets_per_campaign_type(spark):
    risks = spark.createDataFrame(
        [(1, 0.5, 10.0), (2, 0.5, 30.0), (3, 0.1, 30.0), (4, 0.9, 5.0), (9, 1.0, 99.0)],
        "ID_CLI bigint, CHURN_PROBABILITY double, MONEY_AT_RISK double",
    )
    day = "2019-01-02T10:00:00"
    rows = [(n, cli, camp, n, "S", day) for n, (cli, camp) in enumerate([(1, 1), (2, 1), (3, 1), (4, 2), (4, 2), (2, 2), (None, 2), (77, 2)])]
    funnel = email_funnel(type_events(event_frame(spark, rows)), campaign_frame(spark))
    got = {(r.TYP_CAMP, r.RANK): r.ID_CLI for r in churn.top_targets(risks, funnel, 2).collect()}
    assert got == {("PROMO", 1): 2, ("PROMO", 2): 3, ("NEWS", 1): 2, ("NEWS", 2): 4}


def _funnel(spark, seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = None if rng.random() < 0.1 else f"2019-01-{rng.randint(1, 28):02d}T10:00:00"
        ids = [None if rng.random() < 0.05 else rng.randint(1, 6) for _ in range(3)]
        rows.append((i, *ids, rng.choice("SSSVVCE"), at))
    return email_funnel(type_events(event_frame(spark, rows)), campaign_frame(spark, [(1, "A"), (2, "B"), (3, "A"), (4, None)]))


@pytest.mark.parametrize("seed", range(3))
def test_one_reduction_gives_every_figure(spark, seed):
    funnel = _funnel(spark, seed).cache()
    seen = summary.seen_ids(funnel).cache()
    assert funnel.count() > 50
    by_type, of_all = summary.counts_by_type(seen), summary.counts_of_all(seen)
    assert sorted_rows(summary.overview_of(by_type, True)) == sorted_rows(distributions.overview(funnel, "TYP_CAMP"))
    assert sorted_rows(summary.overview_of(of_all, False)) == sorted_rows(distributions.overview(funnel))
    table = summary.funnel_summary(seen)
    for flag in summary.FLAGS:
        for scope, counts, wide in (("type", by_type, True), ("all", of_all, False)):
            want = distributions.flag_shares(funnel, flag, wide)
            assert sorted_rows(summary.shares_of(counts, flag)) == sorted_rows(want)
            part = table.where((F.col("SCOPE") == scope) & (F.col("FLAG") == flag)).drop("SCOPE", "FLAG")
            assert sorted_rows(part.withColumnRenamed("SIDE", flag)) == sorted_rows(want)


def test_a_funnel_without_sends(spark):
    seen = summary.seen_ids(_funnel(spark, 0).where("false"))
    assert summary.funnel_summary(seen).collect() == []


def test_counts_by_type_do_not_shuffle_ids_again(spark, tmp_path):
    summary.seen_ids(_funnel(spark, 1)).write.parquet(str(tmp_path / "seen"))
    counts = summary.counts_by_type(spark.read.parquet(str(tmp_path / "seen")))
    text = counts._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "hashpartitioning(TYP_CAMP" in text


def test_one_file_in_order(spark, tmp_path):
    path = str(tmp_path / "out" / "figures.csv")
    df = spark.range(0, 1000, 1, 7).select((999 - F.col("id")).alias("place"), F.when(F.col("id") % 3 > 0, F.lit("a,\"b\"")).alias("x"))
    write_csv_file(df.orderBy("place"), path)
    assert (tmp_path / "out" / "figures.csv").is_file()
    lines = (tmp_path / "out" / "figures.csv").read_text().splitlines()
    assert lines[0] == "place,x" and [int(line.split(",")[0]) for line in lines[1:]] == list(range(1000))
    assert sorted_rows(read_csv(spark, path, "place bigint, x string")) == sorted_rows(df)
    assert [p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")] == ["figures.csv"]
    # Again over the old file, and without rows.
    write_csv_file(df.where("place < 2"), path)
    assert len((tmp_path / "out" / "figures.csv").read_text().splitlines()) == 3
    write_csv_file(df.where("false"), path)
    assert read_csv(spark, path, "place bigint, x string").count() == 0


def test_a_failed_attempt_leaves_the_old_file_and_is_written_over(spark, tmp_path):
    path = str(tmp_path / "f.csv")
    df = spark.range(3).select(F.col("id").cast("string").alias("k"))
    write_csv_file(df, path)
    broken = df.select(F.when(F.col("k") == "2", F.raise_error(F.lit("no"))).otherwise(F.col("k")).alias("k"))
    with pytest.raises(Exception, match="no"):
        write_csv_file(broken, path)
    assert len((tmp_path / "f.csv").read_text().splitlines()) == 4
    write_csv_file(df.where("k = '1'"), path)
    assert (tmp_path / "f.csv").read_text().splitlines() == ["k", "1"]
