"""The input tables derived from a star schema of orders, parts and events.

Used by the query catalogue and the tests. Every adapter reads its whole source
table; missing values and duplicates are put in by projection, never by
dropping rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# event_type of the source to the type code of an email event.
EVENT_CODES = {"signup": "S", "view": "V", "click": "C", "error": "E", "purchase": "B"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _unless(condition: Column, value: Column) -> Column:
    """``value``, but null where ``condition`` holds."""
    return F.when(~condition, value)


def fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ID_CLI"))


def account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One account row per order; every fifth customer has no address on file."""
    key = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(_unless(key % 5 == 0, key).alias("ID_ADDRESS"))


def address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer, every third one twice, plus one row without an id."""
    key = F.col("c_custkey")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    postcode = F.lpad((key * 7 % 100000).cast("string"), 5, "0")
    located = (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            key.alias("ID_ADDRESS"),
            _unless(key % 29 == 0, postcode).alias("CAP"),
            _unless(key % 17 == 0, F.col("n_name")).alias("PRV"),
            _unless(key % 23 == 0, F.col("r_name")).alias("REGION"),
            F.explode(F.sequence(F.lit(1), F.when(key % 3 == 0, 2).otherwise(1))).alias("copy"),
        )
        .drop("copy")
    )
    unknown = spark.sql(
        "select cast(null as bigint) as ID_ADDRESS, '00100' as CAP,"
        " 'NATION_0' as PRV, 'AFRICA' as REGION"
    )
    return located.unionByName(unknown)


def address_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as text: empty for missing, and a province with the code NA."""
    rows = address(spark, sf_dir)
    province = F.when(F.col("PRV") == "NATION_0", "NA").otherwise(F.col("PRV"))
    return rows.withColumn("PRV", province).select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns)
    )


def campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ID_CAMP"),
        F.col("p_type").alias("TYP_CAMP"),
        F.lit("EMAIL").alias("CHANNEL_CAMP"),
    )


def event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Email events; the number in ``props`` picks the campaign and the delivery."""
    k = F.regexp_extract("props", r'"k": *(\d+)', 1).try_cast("bigint")
    at = F.col("ts").cast("string")
    kind = F.col("event_type")
    code = reduce(lambda c, pair: c.when(kind == pair[0], pair[1]), EVENT_CODES.items(), F)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ID_EVENT"),
        F.col("user_id").alias("ID_CLI"),
        (k % 10).alias("ID_CAMP"),
        (k % 10 * 10 + F.floor(k / 10) % 2).alias("ID_DELIVERY"),
        code.alias("TYP_EVENT"),
        F.concat(F.substr(at, F.lit(1), F.lit(10)), F.lit("T"), F.substr(at, F.lit(12), F.lit(8))).alias(
            "EVENT_DATE"
        ),
    )


def event_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a text column whose values have line breaks, quotes and separators."""
    key = F.col("ID_EVENT")
    note = (
        F.when(key % 5 == 0, F.concat(F.lit("first line\nsecond of "), key.cast("string")))
        .when(key % 5 == 1, F.lit('said "yes";\r\n\r\nthen left'))
        .when(key % 5 == 2, F.lit("\n"))
        .when(key % 5 == 3, F.lit("one line"))
    )
    return event(spark, sf_dir).withColumn("NOTE", note)


def event_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as text with missing values, written as NA or as nothing."""
    rows = event(spark, sf_dir)
    key = F.col("ID_EVENT")
    gaps = {
        "ID_CAMP": (key % 13 == 1, "NA"),
        "ID_DELIVERY": (key % 7 == 2, ""),
        "TYP_EVENT": (key % 31 == 3, "NA"),
        "EVENT_DATE": (key % 17 == 4, ""),
    }
    return rows.select(
        *(
            (F.when(gaps[c][0], gaps[c][1]).otherwise(F.col(c).cast("string")) if c in gaps
             else F.col(c).cast("string")).alias(c)
            for c in rows.columns
        )
    )


def ticket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ID_TICKET"),
        F.col("o_custkey").alias("ID_CLI"),
        F.to_date("o_orderdate").alias("TIC_DATE"),
        F.col("o_totalprice").alias("AMOUNT"),
    )


def basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line: the ticket and the brand bought."""
    line = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("ID_TICKET"), F.col("p_brand").alias("ITEM")
    )
