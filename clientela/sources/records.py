"""Records of delimited text whose quoted values may contain line breaks.

Whether a line begins inside quotes depends on all quotes before it. Each split
of a file counts its own; a sum over the splits tells how each begins, and within
a split the lines go on from there. So a file of any size is read by many tasks,
and only records that cross a split are put together afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

QUOTE = '"'
_SPLIT = ("file", "split")


def odd_quotes(line: Column) -> Column:
    """Whether the number of quotes in a line is odd, so that it opens or closes a value."""
    return (F.length(line) - F.length(F.replace(line, F.lit(QUOTE), F.lit("")))) % 2 == 1


def whole_records(spark: SparkSession, path: str) -> DataFrame:
    """``value`` and ``open`` of every record of a file or folder.

    Lines end with LF or CRLF; line breaks inside quotes stay as they are. Lines
    without a visible character are no records. ``open`` is true for the rest of
    a file after a quote that is never closed. Quotes count wherever they stand,
    also in the middle of an unquoted value.

    The lines are shuffled once, by split. A task holds the lines of a split at a
    time, sorted, and the text of one record.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        # Splits are read line after line, so this orders the lines of each.
        F.monotonically_increasing_id().alias("line"),
        odd_quotes(F.col("value")).cast("int").alias("odd"),
    )
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy(*_SPLIT).agg(F.bit_xor("odd").alias("odd"))
    splits = splits.select(*_SPLIT, (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).alias("opened"))

    in_split = Window.partitionBy(*_SPLIT).orderBy("line")
    before = F.coalesce(F.sum("odd").over(in_split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.join(splits, list(_SPLIT)).withColumn("begins", (F.col("opened") + before) % 2 == 0)
    single = placed.where(F.col("begins") & (F.col("odd") == 0)).select("value", F.lit(False).alias("open"))

    # Lines of longer records, by the line that each record begins with: none for
    # those that go on from an earlier split.
    upto = in_split.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.max(F.when(F.col("begins"), F.col("line"))).over(upto)
    pieces = (
        placed.withColumn("record", first)
        .where(~F.col("begins") | (F.col("odd") == 1))
        .groupBy(*_SPLIT, "record")
        .agg(_joined("line", "value"), F.bit_xor("odd").alias("odd"))
        # A piece that goes on from a split before is open at its beginning.
        .withColumn("open", (F.col("odd") == 1) == F.col("record").isNotNull())
    )
    within = pieces.where(F.col("record").isNotNull() & ~F.col("open")).select("value", "open")
    across = pieces.where(F.col("record").isNull() | F.col("open"))
    along = Window.partitionBy("file").orderBy("split", F.col("record").asc_nulls_first())
    number = F.count("record").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    across = (
        across.withColumn("number", number)
        .groupBy("file", "number")
        .agg(_joined("split", "value"), F.max_by("open", "split").alias("open"))
        .select("value", "open")
    )
    records = within.unionByName(across).unionByName(single)
    text = F.when(F.col("value").endswith("\r"), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    return records.select(text.alias("value"), "open").where(F.trim("value") != "")


def _joined(order: str, text: str) -> Column:
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return F.array_join(F.transform(parts, lambda part: part[text]), "\n").alias(text)
