"""Snapshot documents: one JSON file per snapshot folder, read whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagelib.session import materialise

SCHEMA_VERSION = 1
SNAPSHOT_SCHEMA = (
    "schema_version int, id string, captured_at timestamp, "
    "source struct<browser: string, profile: string, path: string, sha256: string, bytes: long, saved_at: timestamp>, "
    "stats struct<unknown_commands: long, malformed_commands: long, truncated_bytes: long, dropped_tabs: long, "
    "navigation_fallbacks: long, groups_without_metadata: long, marker_count: long>, "
    "windows array<struct<id: int, number: int, kind: string, active_tab: long, tabs: int>>, "
    "groups array<struct<id: string, title: string, colour: string, collapsed: boolean, window: int>>, "
    "tabs array<struct<tab_id: long, window: int, position: int, url: string, title: string, pinned: boolean, "
    "active: boolean, `group`: string, last_active: timestamp>>, _corrupt string")


def _depth(spark: SparkSession, path: str) -> int:
    """Parts of the full path, as `F.split` counts them."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(root)
    return len(full.toUri().getPath().rstrip("/").split("/"))


def read_snapshots(spark: SparkSession, path: str, file: str = "*.json") -> dict[str, DataFrame]:
    """Tables snapshots, windows, groups, tabs, and the unreadable documents.

    `path` holds one folder per snapshot; the folder names it. A document is used
    only if its schema version is 1, every window number is above zero and no tab
    id repeats. Documents are parsed once, into the shared folder, for all tables.
    """
    # Folders are listed by tasks; a pattern with a star for the folder would be matched one by one on the driver.
    docs = (spark.read.schema(SNAPSHOT_SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", file)
            .option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
            .json(path).withColumn("file", F.col("_metadata.file_path")))
    parts = F.split(F.regexp_extract("file", r"^(?:[^/:]+:)?(?://[^/]*)?(/.*)$", 1), "/")
    # Files beside the folders, and in folders below them, are no documents.
    docs = docs.where(F.size(parts) == _depth(spark, path) + 2).withColumn("snapshot_id", F.element_at(parts, -2))
    ids = F.transform("tabs", lambda t: t["tab_id"])
    good = (F.col("_corrupt").isNull() & (F.col("schema_version") == SCHEMA_VERSION)
            & F.forall("tabs", lambda t: t["window"] > 0) & (F.size(F.array_distinct(ids)) == F.size(ids)))
    docs = materialise(docs.withColumn("good", F.coalesce(good, F.lit(False))).drop("_corrupt"), "snapshots")
    used = docs.where("good")
    part = lambda name: used.select("snapshot_id", "captured_at", F.explode(name).alias("x")).select("snapshot_id", "captured_at", "x.*")
    return {
        "snapshots": used.select("snapshot_id", "captured_at", "source", "stats"),
        "windows": part("windows").drop("captured_at"), "groups": part("groups").drop("captured_at"), "tabs": part("tabs"),
        "unreadable": docs.where("not good").select("snapshot_id", "file")}
