"""Data-quality reports: duplicates, missingness, key consistency, profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from clientela.functions.missing import n_distinct
from clientela.functions.quantiles import exact_quantiles

FIVE_NUMBERS = {"MIN": 0.0, "Q1": 0.25, "MEDIAN": 0.5, "Q3": 0.75, "MAX": 1.0}

_PROFILE = (
    "COLUMN string, TYPE string, N_ROWS bigint, N_MISSING bigint, MIN double, Q1 double,"
    " MEDIAN double, MEAN double, Q3 double, MAX double"
)


def duplicate_audit(df: DataFrame, key: str, count: str) -> DataFrame:
    """Distinct keys, named ``count``, against rows, in one row."""
    return df.agg(n_distinct(key).alias(count), F.count(F.lit(1)).alias("TOT_ROWs"))


def missing_patterns(df: DataFrame, columns: Sequence[str], key: str, count: str) -> DataFrame:
    """Distinct keys per combination of present and missing columns."""
    present = [F.col(c).isNotNull().alias(f"w_{c}") for c in columns]
    return df.groupBy(*present).agg(n_distinct(key).alias(count))


def key_audit(
    left: DataFrame, right: DataFrame, key: str, left_flag: str, right_flag: str, count: str
) -> DataFrame:
    """How many keys occur in both tables, only in the left, only in the right.

    One grouping of the marked union replaces a full outer join of two distinct
    key sets: a single shuffle, with repeated keys collapsed before it, and a
    null key meets a null key without special care.
    """
    yes, no = F.lit(1), F.lit(None).cast("int")
    marked = left.select(key, yes.alias(left_flag), no.alias(right_flag)).unionByName(
        right.select(key, no.alias(left_flag), yes.alias(right_flag))
    )
    per_key = marked.groupBy(key).agg(
        F.max(left_flag).alias(left_flag), F.max(right_flag).alias(right_flag)
    )
    return per_key.groupBy(left_flag, right_flag).agg(F.count(F.lit(1)).alias(count))


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def _as_number(column: str, kind: str) -> Column | None:
    """The number a column is summarised by; none for text."""
    if kind.startswith(_NUMBERS):
        return F.col(column).cast("double")
    if kind == "boolean":
        return F.col(column).cast("int").cast("double")
    if kind == "date":
        return F.unix_date(column).cast("double")
    if kind == "timestamp":
        return F.col(column).cast("double")
    if kind == "timestamp_ntz":
        return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast(kind), column).cast("double")
    return None


def profile(df: DataFrame) -> DataFrame:
    """Type, missing count, five-number summary and mean of every column.

    Dates count as days and timestamps as seconds since 1970, booleans as 0 and
    1; text has no numbers. Quartiles are exact. The summary is computed at once,
    in two passes over ``df``, which shuffle counts and a bounded part of the
    values: store ``df`` if it is costly.
    """
    numbers = {i: _as_number(name, kind) for i, (name, kind) in enumerate(df.dtypes)}
    # Rows and known texts are counted in the same pass, as columns of zeros.
    zeros = {i: F.when(F.col(f"`{name}`").isNotNull(), 0.0) for i, name in enumerate(df.columns)}
    counted = {str(i): zeros[i] if number is None else number for i, number in numbers.items()}
    found = exact_quantiles(df, {"rows": F.lit(0.0), **counted}, list(FIVE_NUMBERS.values()))
    total = found["rows"].count
    rows = []
    for i, (name, kind) in enumerate(df.dtypes):
        known = found[str(i)].count
        text = numbers[i] is None
        low, q1, median, q3, high = [None] * 5 if text else found[str(i)].quantiles
        mean = None if text else found[str(i)].mean
        rows.append((name, kind, total, total - known, low, q1, median, mean, q3, high))
    # One row per column of df.
    return df.sparkSession.createDataFrame(rows, _PROFILE)


def top_levels(df: DataFrame, columns: Sequence[str], k: int = 6) -> DataFrame:
    """The ``k`` most frequent values of each text column, the others summed up.

    Missing values have a row of their own. Ties go to the smaller text.
    """
    cells = F.array(
        *(F.struct(F.lit(c).alias("COLUMN"), F.col(c).alias("LEVEL")) for c in columns)
    )
    counts = df.select(F.inline(cells)).groupBy("COLUMN", "LEVEL").agg(
        F.count(F.lit(1)).alias("N")
    )
    known = counts.where(F.col("LEVEL").isNotNull())
    # The rank bound is pushed below the shuffle, so each task sends k rows.
    by_count = Window.partitionBy("COLUMN").orderBy(F.desc("N"), F.asc("LEVEL"))
    top = known.withColumn("r", F.row_number().over(by_count)).where(F.col("r") <= k).drop("r")
    kept = top.groupBy("COLUMN").agg(F.sum("N").alias("kept"))
    others = (
        known.groupBy("COLUMN")
        .agg(F.sum("N").alias("all"))
        .join(kept, "COLUMN")
        .select("COLUMN", F.lit("(Other)").alias("LEVEL"), (F.col("all") - F.col("kept")).alias("N"))
        .where(F.col("N") > 0)
    )
    return top.unionByName(others).unionByName(counts.where(F.col("LEVEL").isNull()))
