"""Browsing signals from visit tables, as set joins over all pages at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagelib.functions import urls

MAX_HOPS = 3


def visit_rollup(visits: DataFrame) -> DataFrame:
    """First visit and whole seconds in the foreground; unknown durations are negative."""
    dwell = F.sum(F.when(F.col("foreground_micros") > 0, F.col("foreground_micros")))
    return visits.groupBy("url_id").agg(
        F.min("visit_time").alias("first_visit"),
        F.floor(dwell / 1000000).cast("long").alias("foreground_seconds"))


def _parents(visits: DataFrame, *carried: str) -> DataFrame:
    """(child, parent) for the visit a visit came from and the one that opened it."""
    has_opener = "opener_visit" in visits.columns
    parents = F.array("from_visit", "opener_visit") if has_opener else F.array("from_visit")
    return visits.select(F.col("id").alias("child"), *carried,
                         F.explode(F.array_distinct(F.array_compact(parents))).alias("parent"))


def search_ancestry(visits: DataFrame, terms: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """The nearest search that led to each page, at most `hops` steps back.

    Kept per visit: its nearest search, then the latest one. A step is one join of the parent links, of which a visit has one
    to itself too, with that table, aggregated per visit; so a step's plan holds the step before once, and its work is
    bounded by the links however many paths lead back. A farther search of a parent cannot be a child's nearest one.
    """
    named = terms.groupBy("url_id").agg(F.min("term").alias("term"))
    itself = visits.select(F.col("id").alias("child"), F.col("id").alias("parent"), F.lit(0).alias("away"))
    links = _parents(visits).withColumn("away", F.lit(1)).unionByName(itself)
    best = visits.join(named, "url_id").select(F.col("id").alias("visit"), F.lit(0).alias("hops"), F.col("visit_time").alias("seen"), "term")
    for _ in range(hops):
        back = F.col("hops") + F.col("away")
        best = (links.join(best, F.col("parent") == F.col("visit"))
                .groupBy("child").agg(F.max(F.struct((-back).alias("near"), "seen", "term")).alias("best"))
                .select(F.col("child").alias("visit"), (-F.col("best.near")).alias("hops"), "best.seen", "best.term"))
    page = visits.select(F.col("id").alias("visit"), "url_id")
    return (best.join(page, "visit").groupBy("url_id")
            .agg(F.max_by(F.struct("term", "hops"), F.struct(-F.col("hops"), "seen", "term")).alias("s"))
            .select("url_id", "s.term", F.col("s.hops").cast("long").alias("hops")))


def _elsewhere(url: Column) -> Column:
    return F.coalesce((url != "") & ~urls.is_this_machine(url), F.lit(False))


def referrer_of(visits: DataFrame, pages: DataFrame) -> DataFrame:
    """The page visited before, else the latest external referrer.

    Of several, the latest child visit wins and the link followed wins over the
    tab that opened it. `pages` has (id, url).
    """
    links = _parents(visits, F.col("url_id").alias("child_url"), "visit_time", "from_visit")
    links = links.groupBy("child_url", "parent").agg(
        F.max(F.struct("visit_time", (F.col("parent") == F.col("from_visit")).alias("followed"),
                       F.col("parent").alias("tie"))).alias("k"))
    parent = visits.select(F.col("id").alias("parent"), F.col("url_id").alias("parent_url"))
    address = pages.select(F.col("id").alias("parent_url"), F.col("url").alias("referrer"))
    inside = (links.join(parent, "parent").where(F.col("parent_url") != F.col("child_url"))
              .join(address, "parent_url").where(_elsewhere(F.col("referrer")))
              .groupBy(F.col("child_url").alias("url_id")).agg(F.max_by("referrer", "k").alias("inside")))
    own = pages.select(F.col("id").alias("url_id"), F.col("url").alias("own"))
    if "external_referrer_url" in visits.columns:
        outside = (visits.where(F.col("external_referrer_url").isNotNull()).join(own, "url_id")
                   .where((F.col("external_referrer_url") != F.col("own"))
                          & _elsewhere(F.col("external_referrer_url")))
                   .groupBy("url_id").agg(F.max_by("external_referrer_url", F.struct("visit_time", "id"))
                                          .alias("outside")))
    else:
        outside = visits.limit(0).select("url_id", F.lit(None).cast("string").alias("outside"))
    return (inside.join(outside, "url_id", "full_outer")
            .select("url_id", F.coalesce("inside", "outside").alias("referrer")))


def visit_signals(pages: DataFrame, visits: DataFrame, terms: DataFrame | None) -> DataFrame:
    """All signals of every known address; one without a last visit has none.

    `pages` has (id, url, visit_count, typed_count, last_visit_time). Every join
    is on the page id, which the aggregated sides are already partitioned by.
    """
    row = (pages.groupBy("url").agg(F.max_by(
        F.struct("id", "visit_count", "typed_count", "last_visit_time"),
        F.struct(F.coalesce("last_visit_time", F.timestamp_micros(F.lit(0))), "id")).alias("r"))
        .select("url", F.col("r.id").alias("url_id"), F.col("r.visit_count").alias("visits"),
                F.col("r.typed_count").alias("typed"), F.col("r.last_visit_time").alias("last_visit"))
        .where(F.col("last_visit").isNotNull()))
    out = row.join(visit_rollup(visits), "url_id", "left")
    if terms is not None:
        out = out.join(search_ancestry(visits, terms), "url_id", "left")
    else:
        out = out.withColumns({"term": F.lit(None).cast("string"), "hops": F.lit(None).cast("long")})
    return out.join(referrer_of(visits, pages), "url_id", "left").drop("url_id")


def history_merge(previous: DataFrame, reading: DataFrame, wanted: DataFrame, at: Column) -> DataFrame:
    """The record after a refresh, with what became of each page.

    `previous` has (url, signals, refreshed_at), `reading` (url, signals),
    `wanted` (url). Looked up and found: new signals, dated `at`. Looked up, not
    found, known before: kept. Others stay as they were. An address stands once in the
    record: of several rows the last refreshed, then the greatest signals count.
    """
    previous = previous.groupBy("url").agg(F.max(F.struct("refreshed_at", "signals")).alias("r")).select("url", "r.*")
    new = reading.groupBy("url").agg(F.max("signals").alias("new")).join(wanted.select("url").distinct(), "url", "left_semi")
    asked = wanted.select("url").distinct().withColumn("asked", F.lit(True))
    merged = (previous.join(new, "url", "full_outer").join(asked, "url", "left"))
    outcome = (F.when(F.col("new").isNotNull(), "found").when(F.col("asked"), "kept").otherwise("untouched"))
    return merged.select("url", F.coalesce("new", "signals").alias("signals"),
                         F.when(F.col("new").isNotNull(), at).otherwise(F.col("refreshed_at")).alias("refreshed_at"),
                         outcome.alias("outcome"))


def history_counts(merged: DataFrame) -> DataFrame:
    n = lambda o: F.count(F.when(F.col("outcome") == o, 1))
    return merged.agg(n("found").alias("found"), n("kept").alias("kept"), F.count(F.lit(1)).alias("recorded"))


def history_status(recorded: DataFrame) -> DataFrame:
    """Recorded pages, and those the latest refresh no longer found."""
    updated = recorded.agg(F.max("refreshed_at")).scalar()
    return recorded.agg(F.count(F.lit(1)).alias("pages"),
                        F.count(F.when(F.col("refreshed_at") < updated, 1)).alias("not_in_history"))
