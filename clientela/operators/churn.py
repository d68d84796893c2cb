"""Which customers are likely to stay away.

A customer has churned who bought up to a reference day and not in the horizon
after it. The horizon is the repurchase interval of ``intervals`` on the same
data unless a number of days is given; the reference day lies one horizon before
the end of the data, so that every label can be observed.

There are two scores: the share of churned customers among those alike in
recency, frequency and money, and a logistic regression on the measures, which
also ranks the customers of a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clientela.functions.logistic import Logistic, fit_logistics
from clientela.functions.ranking import top_per_group
from clientela.operators.intervals import gap_quantile, longest_gaps, repurchase_gaps
from clientela.operators.rfm import MEASURES, Limits, last_day, money, purchase_history, with_scores
from clientela.sources.scratch import stored

CELL = ["R_SCORE", "F_SCORE", "M_SCORE"]
FOLDS = 3
# Places of a modelled probability, so that equal customers tie however the sums
# of the fit were ordered, and a fold has at most a million different scores.
DECIMALS = 6


def horizon(ticket: DataFrame, horizon_days: int | None = None) -> Column:
    """Days that a label looks ahead, as a scalar."""
    if horizon_days is not None:
        return F.lit(horizon_days)
    days = gap_quantile(longest_gaps(repurchase_gaps(ticket)))
    return days.select(F.ceil("DAYS").cast("int")).scalar()


def reference_day(ticket: DataFrame, horizon_days: int | None = None) -> Column:
    """The day whose customers are labelled, as a scalar."""
    return F.date_sub(last_day(ticket), horizon(ticket, horizon_days))


def churn_labels(ticket: DataFrame, horizon_days: int | None = None) -> DataFrame:
    """Customers known at the reference day, their history then, and the label."""
    history = purchase_history(ticket, reference_day(ticket, horizon_days))
    return history.select(
        "ID_CLI", "LAST_DATE", *MEASURES, (~F.col("BOUGHT_AFTER")).alias("CHURNED")
    )


def rolling_labels(
    ticket: DataFrame, days_apart: int = 30, windows: int = 12, horizon_days: int | None = None
) -> DataFrame:
    """``churn_labels`` at ``windows`` reference days, each so many days before the next.

    The last is that of ``churn_labels`` and has the same rows. Earlier ones know
    the history up to their own day, and a customer has churned who did not buy
    within the horizon after it.

    A purchase belongs to the windows that began before it and to those whose
    horizon holds it: two ranges of window numbers that follow from its date, so
    there is no join. History is first summed between reference days; what is
    expanded is at most ``windows`` rows of a customer and window.
    """
    known = ticket.where(F.col("ID_CLI").isNotNull() & F.col("TIC_DATE").isNotNull())
    ahead = horizon(ticket, horizon_days)
    last = reference_day(ticket, horizon_days)
    # Window 0 is the last one; a purchase on day t is known to windows 0 to this.
    earliest = F.floor(F.date_diff(last, "TIC_DATE") / days_apart).cast("int")
    bucket = F.least(earliest, F.lit(windows - 1))

    tickets = (
        known.withColumn("bucket", bucket)
        .where(F.col("bucket") >= 0)
        .groupBy("ID_CLI", "ID_TICKET", "bucket")
        .agg(F.max("TIC_DATE").alias("LAST_DATE"), F.sum(money("AMOUNT")).alias("spent"))
    )
    # A ticket with rows on both sides of a reference day counts where it begins.
    begins = F.col("bucket") == F.max("bucket").over(Window.partitionBy("ID_CLI", "ID_TICKET"))
    new = F.when(begins & F.col("ID_TICKET").isNotNull(), 1).otherwise(0).cast("bigint")
    between = (
        tickets.withColumn("new", new)
        .groupBy("ID_CLI", "bucket")
        .agg(F.max("LAST_DATE").alias("LAST_DATE"), F.sum("new").alias("new"), F.sum("spent").alias("spent"))
    )
    histories = between.select(
        "ID_CLI", F.explode(F.sequence(F.lit(0), "bucket")).alias("window"), "LAST_DATE", "new", "spent",
        F.lit(False).alias("after"),
    )
    first = F.greatest(earliest + 1, F.lit(0))
    until = F.floor((F.date_diff(last, "TIC_DATE") + ahead) / days_apart).cast("int")
    held = F.sequence(first, F.least(until, F.lit(windows - 1)))
    returns = known.select(
        "ID_CLI", F.explode(F.when(first <= F.least(until, F.lit(windows - 1)), held)).alias("window"),
        F.lit(None).cast("date").alias("LAST_DATE"), F.lit(0).cast("bigint").alias("new"),
        F.lit(None).cast("decimal(28,2)").alias("spent"), F.lit(True).alias("after"),
    )
    labelled = (
        histories.unionByName(returns)
        .groupBy("ID_CLI", "window")
        .agg(
            F.max("LAST_DATE").alias("LAST_DATE"), F.sum("new").alias("FREQUENCY"),
            F.sum("spent").cast("double").alias("MONETARY"), (~F.bool_or("after")).alias("CHURNED"),
        )
        .where(F.col("LAST_DATE").isNotNull())
        .withColumn("REF_DATE", F.date_sub(last, F.col("window") * days_apart))
    )
    recency = F.date_diff("REF_DATE", "LAST_DATE").alias("RECENCY")
    return labelled.select("REF_DATE", "ID_CLI", "LAST_DATE", recency, "FREQUENCY", "MONETARY", "CHURNED")


def churn_rates(scored: DataFrame) -> DataFrame:
    """Churn per cell of scores, all 125 of them: R_SCORE, F_SCORE, M_SCORE, CHURN_PROBABILITY.

    ``scored`` are labels with scores. A cell without customers has the rate of
    its recency score, and that of everyone if this has none either.
    """
    counts = scored.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.count_if("CHURNED").alias("c"))
    return _with_rate(_grid(scored).join(counts, CELL, "left").fillna(0, ["n", "c"])).select(
        *CELL, "CHURN_PROBABILITY"
    )


def _grid(df: DataFrame) -> DataFrame:
    """All combinations of the three scores."""
    grid = df.sparkSession.range(1)
    for score in CELL:
        grid = grid.withColumn(score, F.explode(F.sequence(F.lit(1), F.lit(5))))
    return grid.drop("id")


def _with_rate(cells: DataFrame, *by: str) -> DataFrame:
    """Rate of each cell from its n and c, with the fallbacks of ``churn_rates``."""

    def share(*keys: str) -> Column:
        alike = Window.partitionBy(*by, *keys)
        return F.try_divide(F.sum("c").over(alike), F.sum("n").over(alike))

    return cells.withColumn("CHURN_PROBABILITY", F.coalesce(share(*CELL), share(CELL[0]), share()))


def churn_scores(customers: DataFrame, limits: Limits, rates: DataFrame) -> DataFrame:
    """Probability of churn for customers with a purchase history.

    ``limits`` are those of the labels that gave ``rates``. The 125 rates are
    broadcast.
    """
    scored = with_scores(customers, limits).join(F.broadcast(rates), CELL)
    return scored.select("ID_CLI", *MEASURES, "CHURN_PROBABILITY")


def current_customers(ticket: DataFrame) -> DataFrame:
    """Everyone's history at the end of the data, the input of scoring."""
    return purchase_history(ticket, last_day(ticket)).select("ID_CLI", *MEASURES)


def churn_quality(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve on customers the rates were not made from.

    Customers are dealt into folds by their id, and each is scored by the rates
    of the other folds. One aggregation of ``scored`` gives the counts of cells
    and folds; all else happens on these 375 rows. The area is exact: the share
    of pairs of a churned and another customer that the score puts in order,
    half of them where it is equal.
    """
    fold = F.pmod("ID_CLI", F.lit(FOLDS)).cast("int").alias("FOLD")
    counts = scored.groupBy(fold, *CELL).agg(
        F.count(F.lit(1)).alias("own_n"), F.count_if("CHURNED").alias("own_c")
    )
    folds = F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1)))
    cells = _grid(scored).withColumn("FOLD", folds).join(counts, ["FOLD", *CELL], "left")
    cells = cells.fillna(0, ["own_n", "own_c"])
    all_folds = Window.partitionBy(*CELL)
    others = cells.withColumns(
        {x: F.sum(f"own_{x}").over(all_folds) - F.col(f"own_{x}") for x in ("n", "c")}
    )
    return ranking_quality(
        _with_rate(others, "FOLD")
        .where("own_n > 0")
        .select(
            "FOLD", "CHURN_PROBABILITY", F.col("own_c").alias("positive"), (F.col("own_n") - F.col("own_c")).alias("negative")
        )
    )


def ranking_quality(counts: DataFrame) -> DataFrame:
    """FOLD and AUC from numbers of positives and negatives per fold and score.

    Null if a fold has no positives or no negatives.
    """
    scores = counts.groupBy("FOLD", "CHURN_PROBABILITY").agg(
        F.sum("positive").alias("positive"), F.sum("negative").alias("negative")
    )
    below = F.sum("negative").over(Window.partitionBy("FOLD").orderBy("CHURN_PROBABILITY")) - F.col("negative")
    ordered = scores.withColumn("ordered", F.col("positive") * (2 * below + F.col("negative")))
    pairs = 2 * F.sum("positive") * F.sum("negative")
    return ordered.groupBy("FOLD").agg(F.try_divide(F.sum("ordered"), pairs).alias("AUC"))


def money_at_risk(scores: DataFrame) -> DataFrame:
    """All scored customers with the money that is at risk with them."""
    return scores.withColumn("MONEY_AT_RISK", F.col("CHURN_PROBABILITY") * F.col("MONETARY"))


def top_targets(risks: DataFrame, funnel: DataFrame, k: int) -> DataFrame:
    """Whom to address first: per campaign type the ``k`` customers with most money at risk.

    The customers of a type are those it was sent to; all scored customers are in
    ``risks``. Equal risks go to the smaller id.
    """
    reached = funnel.where(F.col("ID_CLI").isNotNull()).select("TYP_CAMP", "ID_CLI").distinct()
    candidates = stored(reached.join(risks, "ID_CLI").select("TYP_CAMP", "ID_CLI", "CHURN_PROBABILITY", "MONEY_AT_RISK"))
    return top_per_group(candidates, "TYP_CAMP", "MONEY_AT_RISK", "ID_CLI", k)


def with_engagement(customers: DataFrame, funnel: DataFrame) -> DataFrame:
    """How the customers reacted to email so far."""
    engagement = funnel.groupBy("ID_CLI").agg(
        F.count(F.lit(1)).alias("SENDS"),
        F.count_if("OPENED").alias("OPENS"),
        F.count_if("CLICKED").alias("CLICKS"),
    )
    return customers.join(engagement, "ID_CLI", "left").fillna(0, ["SENDS", "OPENS", "CLICKS"])


def _inputs() -> list[Column]:
    """What the regression sees: recency, and frequency and money by their logarithms."""
    money = F.greatest(F.col("MONETARY"), F.lit(0.0))
    return [F.col("RECENCY"), F.log1p("FREQUENCY"), F.log1p(money)]


def churn_model(labels: DataFrame) -> Logistic:
    """Logistic regression of the label on recency, frequency and money.

    ``labels`` are read once per step: store them. Labels of one kind give that
    probability to everyone, no labels a null.
    """
    return fit_logistics(labels, F.col("CHURNED"), _inputs(), {"all": F.lit(True)})["all"]


def model_scores(model: Logistic, customers: DataFrame) -> DataFrame:
    """Probability of churn by the regression, to ``DECIMALS`` places."""
    probability = F.round(model.probability(_inputs()), DECIMALS).alias("CHURN_PROBABILITY")
    return customers.select("ID_CLI", *MEASURES, probability)


def model_quality(labels: DataFrame) -> DataFrame:
    """``churn_quality`` of the regression: each fold by the model of the others.

    The models of all folds take their steps in the same passes over ``labels``.
    """
    fold = F.pmod("ID_CLI", F.lit(FOLDS)).cast("int")
    others = {str(k): fold != k for k in range(FOLDS)}
    models = fit_logistics(labels, F.col("CHURNED"), _inputs(), others)
    by_fold = [F.when(fold == k, models[str(k)].probability(_inputs())) for k in range(FOLDS)]
    scored = labels.select(
        fold.alias("FOLD"),
        F.round(F.coalesce(*by_fold), DECIMALS).alias("CHURN_PROBABILITY"),
        F.col("CHURNED").cast("int").alias("positive"),
        (~F.col("CHURNED")).cast("int").alias("negative"),
    )
    return ranking_quality(scored)
