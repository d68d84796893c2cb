"""The first rows of every group, without sorting the groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from clientela.functions.quantiles import BLOCK, leading_key


def top_per_group(df: DataFrame, group: str, score: str, tie: str, k: int, rank: str = "RANK") -> DataFrame:
    """The ``k`` rows of each ``group`` with the largest ``score``, numbered from 1.

    Equal scores are ranked by the smaller ``tie``; rows alike in both are told
    apart arbitrarily. Rows without a score are in no list; null is a group.

    Tasks count their rows per group and leading digits of the score. From the
    counts follows the least key that can be among the first k, and only rows
    from there on are ranked: k, and those that share the last key. Of these each
    task passes on k per group, so a hot group or score loads no task. ``df`` is
    read twice: store it.
    """
    key, least, of = "_key", "_least", "_group"
    keyed = df.withColumn(key, leading_key(score, BLOCK)).where(F.col(key).isNotNull())
    counts = keyed.groupBy(group, key).agg(F.count(F.lit(1)).alias("n"))
    higher = Window.partitionBy(group).orderBy(F.desc(key)).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(higher), F.lit(0))
    bounds = counts.withColumn("before", before).where(F.col("before") < k).groupBy(group).agg(F.min(key).alias(least))
    bounds = bounds.withColumnRenamed(group, of)
    high = keyed.join(bounds, F.col(group).eqNullSafe(F.col(of)) & (F.col(key) >= F.col(least)))
    order = Window.partitionBy(group).orderBy(F.desc(score), F.asc(tie))
    return high.select(*df.columns, F.row_number().over(order).alias(rank)).where(F.col(rank) <= k)
