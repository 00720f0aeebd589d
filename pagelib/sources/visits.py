"""Visit tables of a browsing history, from a folder of tables or a JDBC source."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagelib.functions.text import chrome_time

# Required columns, and those that arrived later and each feed one signal.
REQUIRED = {"urls": ["id", "url", "visit_count", "typed_count", "last_visit_time"],
            "visits": ["id", "url", "visit_time", "from_visit"]}
OPTIONAL = [("visits", "opener_visit", "long"), ("visits", "external_referrer_url", "string"),
            ("context_annotations", "visit_id", "long"), ("context_annotations", "total_foreground_duration", "long"),
            ("keyword_search_terms", "url_id", "long"), ("keyword_search_terms", "term", "string")]


class MissingColumn(ValueError):
    """A table or column without which no signal can be read."""


def parquet_loader(spark: SparkSession, path: str) -> Callable[[str], DataFrame | None]:
    def load(table: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{path}/{table}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    return load


# What drivers say of a table that is not there: SQLite, PostgreSQL, MySQL, Derby, DuckDB, H2.
MISSING_TABLE = re.compile(r"no such table|relation .* does not exist|table .* (?:doesn't exist|does not exist|not found)", re.I)


def jdbc_options(url: str, table: str, split: dict[str, tuple[str, int, int, int]] | None = None, **options) -> dict[str, str]:
    """Options of one table's read. `split` names for a table the (column, smallest, largest, parts) that it is read in by
    as many tasks; values beyond the ends are read by the first and the last. A table without an entry is one task's work."""
    out = {"url": url, "dbtable": table, **{k: str(v) for k, v in options.items()}}
    if split and table in split:
        column, low, high, parts = split[table]
        # The upper end of the last part is open, so the largest value itself is in it.
        out |= {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(max(high, low + 1)), "numPartitions": str(max(parts, 1))}
    return out


def jdbc_loader(spark: SparkSession, url: str, split: dict[str, tuple[str, int, int, int]] | None = None,
                **options) -> Callable[[str], DataFrame | None]:
    """Tables of a database through a JDBC driver the cluster has; a missing table counts as absent."""
    def load(table: str) -> DataFrame | None:
        try:
            return spark.read.format("jdbc").options(**jdbc_options(url, table, split, **options)).load()
        except Exception as e:
            # Only a missing table counts as absent; a refused login or a lost connection is an error.
            if MISSING_TABLE.search(str(e)):
                return None
            raise

    return load


def read_visits(load: Callable[[str], DataFrame | None]) -> tuple[dict[str, DataFrame], list[str]]:
    """(tables, unavailable columns): `pages`, `visits` and `terms` as the visit operators take them.

    Times are microseconds since 1601. A signal whose columns are missing is NULL and
    its columns are listed.
    """
    tables = {t: load(t) for t in ("urls", "visits", "context_annotations", "keyword_search_terms")}
    for table, columns in REQUIRED.items():
        if tables[table] is None:
            raise MissingColumn(f"{table} table")
        for c in columns:
            if c not in tables[table].columns:
                raise MissingColumn(f"{table}.{c} column")
    has = lambda t, c: tables[t] is not None and c in tables[t].columns
    unavailable = [f"{t}.{c}" for t, c, _ in OPTIONAL if not has(t, c)]
    u, v = tables["urls"], tables["visits"]
    for t, c, kind in OPTIONAL[:2]:
        if not has(t, c):
            v = v.withColumn(c, F.lit(None).cast(kind))
    v = v.select("id", F.col("url").alias("url_id"), chrome_time("visit_time").alias("visit_time"), F.nullif("from_visit", F.lit(0)).alias("from_visit"),
                 F.nullif("opener_visit", F.lit(0)).alias("opener_visit"), "external_referrer_url")
    if has("context_annotations", "visit_id") and has("context_annotations", "total_foreground_duration"):
        dwell = tables["context_annotations"].groupBy(F.col("visit_id").alias("id")).agg(
            F.sum(F.when(F.col("total_foreground_duration") > 0, F.col("total_foreground_duration"))).alias("foreground_micros"))
        v = v.join(dwell, "id", "left")
    else:
        v = v.withColumn("foreground_micros", F.lit(None).cast("long"))
    terms = tables["keyword_search_terms"].select("url_id", "term") if has("keyword_search_terms", "term") and has(
        "keyword_search_terms", "url_id") else None
    pages = u.select("id", "url", "visit_count", "typed_count", chrome_time("last_visit_time").alias("last_visit_time"))
    return {"pages": pages, "visits": v, "terms": terms}, unavailable


def newest_visit(visits: DataFrame) -> DataFrame:
    return visits.agg(F.max("visit_time").alias("newest_visit"))
