"""What the library writes: exports, worklists and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagelib.operators import library as lib


def write_library(tabs: DataFrame, pages: DataFrame, stats: DataFrame, vocabulary: DataFrame, path: str) -> None:
    """The library as JSON Lines folders: stats, snapshots, tabs, pages and vocabulary.

    The nested document's tab tuples are one line each, keyed by snapshot and page
    address, so a snapshot of any size is written by many tasks.
    """
    placed = lib.listed(lib.renumber_positions(tabs)).join(pages.select("url"), "url", "left_semi")
    snapshots = placed.groupBy("snapshot_id").agg(F.max("captured_at").alias("captured_at"),
                                                  F.countDistinct("window").alias("windows"), F.count(F.lit(1)).alias("tabs_total"))
    write = lambda df, name: df.write.mode("overwrite").json(f"{path}/{name}", ignoreNullFields=True)
    write(stats, "stats")
    write(snapshots, "snapshots")
    write(placed.select("snapshot_id", "url", "window", "position", "tab_id", F.col("pinned").cast("int").alias("pinned"), "group"), "tabs")
    write(pages, "pages")
    write(vocabulary.where(F.col("retired_at").isNull()), "vocabulary")


def worklist(due: DataFrame, metadata: DataFrame) -> DataFrame:
    """One line per due page, enriched where the fetch saw the page itself.

    `due` has (url, title, skipped), `metadata` (url, status, title, description).
    """
    m = metadata.where(F.col("status") == "ok").select("url", F.col("title").alias("page_title"), "description")
    collapse = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    j = due.where(F.col("skipped").isNull()).join(m, "url", "left")
    title = collapse("title")
    own = collapse("page_title")
    return j.select("url", F.coalesce(title, F.lit("")).alias("title"),
                    F.when(~F.lower(own).eqNullSafe(F.lower(F.coalesce(title, F.lit("")))), own).alias("page_title"),
                    collapse("description").alias("description"))


def write_worklist(lines: DataFrame, path: str) -> None:
    """Absent fields are left out of a line."""
    lines.write.mode("overwrite").json(path, ignoreNullFields=True)


def suggestion_lines(predictions: DataFrame, owned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """({url, tags} lines, score rows) of predicted tags a page lacks.

    `predictions` has (url, title, tag, score, threshold, prediction), `owned` (url, tag).
    A page's tags are at most the vocabulary, so the list per line is short.
    """
    new = predictions.where(F.col("score") >= F.col("threshold")).join(owned.select("url", "tag"), ["url", "tag"], "left_anti")
    lines = new.groupBy("url").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    held = owned.groupBy("url").agg(F.array_join(F.array_sort(F.collect_set("tag")), "; ").alias("owner_tags"))
    digits = lambda c: F.format_string("%.4f", F.col(c))
    scores = new.join(held, "url", "left").select(
        "url", "title", F.coalesce("owner_tags", F.lit("")).alias("owner_tags"), F.col("tag").alias("suggested_tag"),
        digits("score").alias("score"), digits("threshold").alias("threshold"), "prediction")
    return lines, scores


def write_suggestions(lines: DataFrame, scores: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").json(f"{path}/suggestions")
    scores.write.mode("overwrite").csv(f"{path}/scores", header=True)


def keep_content(changed: DataFrame, path: str) -> None:
    """Appends the changed texts to the keyed store, one file row per key and hash."""
    changed.write.mode("append").parquet(path)


