"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 4 << 20

def configure(spark: SparkSession) -> SparkSession:
    """Settings every operator relies on: UTC timestamps and adaptive execution."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def bound_batches(spark: SparkSession) -> SparkSession:
    """Rows go to Python in batches of bounded size: 10,000 pages at once, Spark's default, may be of any size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (`spark.checkpoint.dir`).

    A local session without the setting, as in tests, uses a temporary folder. On a cluster the setting is required:
    each executor would write to its own disk, and reads would come back incomplete.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = spark.conf.get("spark.pagelib.scratch", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="pagelib-")
        spark.conf.set("spark.pagelib.scratch", own)
    return own


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage through a table in the shared folder; survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
