"""Connected components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clientela.sources.scratch import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    )


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable node of every linked node: node, component.

    ``links`` has two columns of ids; direction, repetitions, nulls and links to
    oneself do not matter. Alternates large-star and small-star steps, which
    move edges towards the smallest node until each component is one star; the
    number of rounds grows with the logarithm of the longest path. A node with
    many neighbours never meets them in one task: minima are combined before
    the shuffle, and the join back is split by adaptive execution. Every round
    is written to the shared folder, so a lost executor costs one round at most.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    known = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    edges = stored(edges.where(known).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = (
            both.join(smallest, "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = stored(large)
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = (
            large.join(smallest, "u")
            .where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        small = smallest.select("u", F.col("m").alias("v")).unionByName(moved).distinct()
        edges = stored(small)
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node")).distinct()
    return (
        edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .unionByName(roots.select("node", F.col("node").alias("component")))
    )
