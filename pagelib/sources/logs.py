"""JSON Lines logs: append only, unreadable lines counted and skipped."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

CORRUPT = "_corrupt"


def log_schema(schema: StructType | str) -> StructType:
    """`schema` with the version and a place for lines that are not records."""
    base = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out = StructType(list(base.fields))
    if "schema_version" not in out.names:
        out = out.add("schema_version", IntegerType())
    return out.add(CORRUPT, StringType())


def unreadable(version: int, required: list[str]) -> Column:
    bad = F.col(CORRUPT).isNotNull() | ~F.col("schema_version").eqNullSafe(F.lit(version))
    for c in required:
        bad = bad | F.col(c).isNull()
    return bad


def read_log(spark: SparkSession, path: str, schema: StructType | str, version: int = 1,
             required: list[str] = ("url",)) -> tuple[DataFrame, DataFrame]:
    """(rows, one-row unreadable count) of a log; a missing log is empty, blank lines do not count."""
    full = log_schema(schema)
    try:
        lines = (spark.read.schema(full).option("mode", "PERMISSIVE")
                 .option("columnNameOfCorruptRecord", CORRUPT).json(path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], full)
    bad = unreadable(version, list(required))
    return (lines.where(~bad).drop(CORRUPT, "schema_version"),
            lines.agg(F.count(F.when(bad, 1)).alias("unreadable")))


def append_log(df: DataFrame, path: str, version: int = 1) -> None:
    """One whole line per record; existing lines are never rewritten."""
    df.withColumn("schema_version", F.lit(version)).write.mode("append").json(path, ignoreNullFields=True)
