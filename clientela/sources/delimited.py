"""Delimited text: semicolon scans with decimal commas, comma-separated sink."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clientela.functions.missing import tokens_to_null
from clientela.sources.records import odd_quotes, whole_records
from clientela.sources.scratch import stored
from clientela.sources.tables import TABLES, Table

_FORMAT = {"sep": ";", "quote": '"', "escape": '"'}
# Fields of a record beyond the header's, and records with an open quote.
_SURPLUS, _OPEN = "surplus field", "open quote"


def _failure(text: str, value: Column) -> Column:
    return F.raise_error(F.concat(F.lit(text), F.coalesce(F.substr(value, F.lit(1), F.lit(80)), F.lit(""))))


def _number(column: str, kind: str) -> Column:
    text = F.col(column)
    if kind == "double":
        text = F.replace(text, F.lit(","), F.lit("."))
    return text.try_cast(kind)


def _unreadable(column: str, kind: str) -> Column:
    return F.col(column).isNotNull() & _number(column, kind).isNull()


def typed(column: str, kind: str, strict: bool = True) -> Column:
    """Text to ``kind``. Numbers use a decimal comma. Unreadable text fails, or is
    null if not ``strict``."""
    value = _number(column, kind)
    if strict:
        message = _failure(f"column {column} is no {kind}: ", F.col(column))
        value = F.when(_unreadable(column, kind), message).otherwise(value)
    return value.alias(column)


def apply_table_rules(text: DataFrame, table: str, strict: bool = True) -> DataFrame:
    """Null the table's missing-value tokens, then cast its known columns."""
    return _by_rules(text, TABLES[table], strict)


def _by_rules(text: DataFrame, rules: Table, strict: bool) -> DataFrame:
    clean = tokens_to_null(text, rules.missing)
    return clean.select(
        *(typed(c, rules.types[c], strict) if c in rules.types else F.col(c) for c in clean.columns)
    )


def _records(spark: SparkSession, path: str, multiline: bool) -> DataFrame:
    """All fields as text, the first surplus field, and whether a quote is open."""
    header = spark.read.text(path).first()
    if header is None:
        raise ValueError(f"{path} has no header")
    names = next(csv.reader([header[0]], delimiter=";"))
    schema = ", ".join(f"`{name}` string" for name in [*names, _SURPLUS])
    if multiline:
        lines = whole_records(spark, path).where(F.col("value") != header[0])
    else:
        lines = spark.read.text(path).where((F.col("value") != header[0]) & (F.trim("value") != ""))
        lines = lines.withColumn("open", odd_quotes(F.col("value")))
    parsed = lines.select(F.from_csv("value", schema, _FORMAT).alias("fields"), F.col("open").alias(_OPEN))
    return parsed.select("fields.*", _OPEN)


def scan_table(
    spark: SparkSession, data_dir: str, table: str, multiline: bool = False, strict: bool = True
) -> DataFrame:
    """Read one input table. Nothing is inferred: all text, then cast by name.

    Records are one line each; with ``multiline`` quoted values may have line
    breaks, for one shuffle of the lines. Large files split across tasks either
    way. The header is one line. Lines equal to it are headers. Records with
    fewer fields than the header are filled up. A surplus field, a quote that is
    left open, by a line or with ``multiline`` by a file, and a number that cannot
    be read fail with the value; if not ``strict``, what cannot be kept is lost as
    ``scan_losses`` counts it.
    """
    return scan_file(spark, f"{data_dir}/{TABLES[table].file}", TABLES[table], multiline, strict)


def scan_file(
    spark: SparkSession, path: str, rules: Table, multiline: bool = False, strict: bool = True
) -> DataFrame:
    """Read one delimited file or folder by the rules of a table, as ``scan_table``."""
    records = _records(spark, path, multiline)
    names = records.columns[:-2]
    if strict:
        whole = (
            F.when(F.col(_OPEN), _failure("a quoted value goes on in the next line: ", F.col(f"`{names[0]}`")))
            .when(F.col(_SURPLUS).isNotNull(), _failure("more fields than the header: ", F.col(_SURPLUS)))
            .otherwise(F.lit(True))
        )
        records = records.where(whole)
    return _by_rules(records.select(*(f"`{n}`" for n in names)), rules, strict)


def scan_losses(spark: SparkSession, data_dir: str, table: str, multiline: bool = False) -> DataFrame:
    """What a scan that is not strict loses, in one row: records, records with
    surplus fields, records with an open quote, and unreadable values."""
    records = _records(spark, f"{data_dir}/{TABLES[table].file}", multiline)
    rules = TABLES[table]
    clean = tokens_to_null(records, rules.missing)
    bad = [F.count_if(_unreadable(c, k)) for c, k in rules.types.items() if c in clean.columns]
    return clean.agg(
        F.lit(table).alias("TABLE"),
        F.count(F.lit(1)).alias("RECORDS"),
        F.count_if(F.col(_SURPLUS).isNotNull()).alias("SURPLUS_FIELDS"),
        F.count_if(_OPEN).alias("OPEN_QUOTES"),
        sum(bad, F.lit(0).cast("bigint")).alias("UNREADABLE_VALUES"),
    )


def write_table(df: DataFrame, data_dir: str, table: str) -> None:
    """Write ``df`` in the layout that ``scan_table`` reads, with ``multiline`` if
    values have line breaks.

    Missing values become the table's first token. That is NA where it may be,
    because a row of nothing but empty fields could be taken for a blank line.
    """
    text = [
        F.replace(F.col(c).cast("string"), F.lit("."), F.lit(",")).alias(c)
        if kind == "double"
        else F.col(c)
        for c, kind in df.dtypes
    ]
    rules = TABLES[table]
    df.select(*text).write.mode("overwrite").csv(
        f"{data_dir}/{rules.file}",
        header=True,
        **_FORMAT,
        nullValue=rules.missing[0],
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


_RESULT = {
    "header": True, "nullValue": "NA", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def write_csv(df: DataFrame, path: str) -> None:
    """Write a result table: comma separated, header, NA for missing, no row numbers."""
    df.write.mode("overwrite").csv(path, **_RESULT)


def write_csv_file(df: DataFrame, path: str) -> None:
    """``write_csv`` to one file at ``path``, rows in the order of ``df``.

    All tasks compute the rows, which are stored with their place; then one task
    writes them in order, sorting with spill, since a file has one writer. The
    finished file is renamed to ``path`` on the session's file system, over an
    earlier one. Until then everything is in the folder ``path`` + ``.parts``,
    which a failed attempt leaves behind and the next one writes over.
    """
    spark = df.sparkSession
    folder = f"{path}.parts"
    place = "place"
    while place in {c.lower() for c in df.columns}:
        place = f"_{place}"
    rows = stored(df.withColumn(place, F.monotonically_increasing_id()), f"{folder}/rows")
    ordered = rows.coalesce(1).sortWithinPartitions(place).drop(place)
    ordered.write.mode("overwrite").csv(f"{folder}/csv", **_RESULT)

    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    parts = hadoop.Path(f"{folder}/csv")
    files = parts.getFileSystem(conf)
    (written,) = [s.getPath() for s in files.globStatus(hadoop.Path(parts, "part-*"))]
    over = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    over[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    target = files.makeQualified(hadoop.Path(path))
    hadoop.FileContext.getFileContext(target.toUri(), conf).rename(written, target, over)
    files.delete(hadoop.Path(folder), True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read back a table written by ``write_csv``."""
    return spark.read.schema(schema).csv(path, header=True, nullValue="NA")
