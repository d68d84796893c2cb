"""Intermediate tables in a folder that all executors can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Used without ``spark.checkpoint.dir``. It has no scheme, so it lies on the
# session's default file system: shared on a cluster, local for a local session.
DEFAULT_DIR = "/tmp/clientela-scratch"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder, not yet created, for one intermediate result."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or DEFAULT_DIR
    return f"{shared.rstrip('/')}/clientela-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written once as parquet and read back.

    For results that several later steps read. Unlike a cache the table survives
    lost executors, and it cuts the lineage. Folders made up here are left for
    the owner of the shared folder to expire, like Spark's own checkpoints.
    """
    path = path or f"{scratch_dir(df.sparkSession)}/table"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
