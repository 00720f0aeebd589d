"""Append-only logs: latest record per key, attempts, outcome counts, bookmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagelib.functions import ordered, urls
from pagelib.functions.ordered import Coarse

RUNS_BEFORE_UNAVAILABLE = 3
# The post site, its link shortener and its media host.
POST_HOSTS = ["x.com", "twitter.com", "t.co", "twimg.com"]


def latest_by_key(log: DataFrame, key: str = "url", seq: str = "seq") -> DataFrame:
    """The last record of every key; records combine map-side."""
    rest = [c for c in log.columns if c != key]
    return (log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r"))
            .select(key, *[F.col(f"r.{c}").alias(c) for c in rest]))


def attempt_numbers(log: DataFrame, key: str = "url", seq: str = "seq", carried: str | None = None) -> DataFrame:
    """Numbers each record of its page's run of errors; every third error gives up.

    The attempt follows from how many errors lie directly before the record:
    all errors so far less those up to the last other outcome, cut every three
    because giving up starts the count afresh. Both are running aggregates, so
    a page with any number of records spreads over tasks. `carried` names a column with the errors that
    stand before a page's first record.
    """
    error = F.col("status") == "error"
    coarse = [Coarse(ordered.id_bucket(seq, 1 << 16))]
    order = [F.col(seq)]
    counted = ordered.running(log, [key], order, coarse, "errors",
                              F.when(error, 1).otherwise(0).cast("long"), "sum", inclusive=False)
    marked = ordered.running(counted, [key], order, coarse, "base",
                             F.when(~error, F.col("errors")), "max", inclusive=False)
    at_first = F.lit(0) if carried is None else -F.col(carried)
    before = F.col("errors") - F.coalesce("base", at_first)
    attempt = before % RUNS_BEFORE_UNAVAILABLE + 1
    gives_up = error & (F.col("attempt") >= RUNS_BEFORE_UNAVAILABLE)
    return (marked.withColumn("attempt", attempt).withColumns({
        "settled_status": F.when(gives_up, "unavailable").otherwise(F.col("status")),
        "settled_reason": F.when(gives_up, F.concat(
            F.coalesce("reason", F.lit("")), F.lit("; failed on "), F.col("attempt").cast("string"),
            F.lit(" runs"))).otherwise(F.col("reason"))}).drop("errors", "base"))


def status_counts(log: DataFrame) -> DataFrame:
    return latest_by_key(log).groupBy("status").agg(F.count(F.lit(1)).alias("pages"))


def status_reasons(log: DataFrame) -> DataFrame:
    """Pages by latest status and reason, for outcomes other than ok."""
    return (latest_by_key(log).where(F.col("status") != "ok")
            .groupBy("status", F.coalesce("reason", F.lit("")).alias("reason"))
            .agg(F.count(F.lit(1)).alias("pages")))


def duration_spread(df: DataFrame, value: str) -> DataFrame:
    """The element at index n/2 of the sorted values, and the longest.

    Found from counts per distinct value, so nothing is sorted in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    run = ordered.running(counts, [], [F.col(value)], [Coarse(F.floor(F.col(value)))], "upto", F.col("n"))
    total = df.agg(F.count(value)).scalar()
    return run.agg(F.min(F.when(F.col("upto") >= F.floor(total / 2) + 1, F.col(value))).alias("median"),
                   F.max(value).alias("longest"))


def bookmark_fold(log: DataFrame) -> DataFrame:
    """Marks of pages with a click, one row per listed item.

    `kind` is clicked (latest click first, of equal times the later line),
    thread or link (both in order of first mention). Items are made distinct by
    aggregation before they are numbered, so a thread of any length spreads out.
    """
    clicks = log.where(F.col("post").isNotNull())
    clicked = clicks.groupBy("url", F.col("post").alias("value")).agg(
        F.max(F.struct("clicked_at", "seq")).alias("k"))
    clicked = ordered.row_number(
        clicked, ["url"], [F.desc("k.clicked_at"), F.desc("k.seq")],
        [Coarse(F.date_trunc("day", F.col("k.clicked_at")), descending=True)], "place")

    def union(column: str, kind: str) -> DataFrame:
        items = log.select("url", "seq", F.posexplode(column).alias("pos", "value"))
        firsts = items.groupBy("url", "value").agg(F.min(F.struct("seq", "pos")).alias("k"))
        return ordered.row_number(firsts, ["url"], [F.col("k.seq"), F.col("k.pos")],
                                  [Coarse(ordered.id_bucket(F.col("k.seq"), 1 << 16))], "place").select(
            "url", F.lit(kind).alias("kind"), "value", "place")

    items = (clicked.select("url", F.lit("clicked").alias("kind"), "value", "place")
             .unionByName(union("posts", "thread")).unionByName(union("links", "link")))
    marked = clicks.groupBy("url").agg(F.max("clicked_at").alias("bookmarked_at"))
    return items.join(marked, "url")


def linked_from(log: DataFrame) -> DataFrame:
    """Page and the bookmarked pages whose threads link to it."""
    marks = bookmark_fold(log)
    return (marks.where(F.col("kind") == "link")
            .select(F.col("value").alias("url"), F.col("url").alias("linked_from")))


def thread_page(log: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked set of posts the saved page whose thread holds any of them.

    `asked` has (ask, post). The latest bookmarked page wins, then the greatest key.
    """
    threads = bookmark_fold(log).where(F.col("kind") == "thread").select(
        F.col("value").alias("post"), "url", "bookmarked_at")
    best = threads.groupBy("post").agg(F.max(F.struct("bookmarked_at", "url")).alias("best"))
    return (asked.join(best, "post").groupBy("ask").agg(F.max("best").alias("best"))
            .select("ask", F.col("best.url").alias("url")))


def refusal(url: str | Column) -> Column:
    """Why an address may not be added; NULL when it may."""
    return (F.when(~urls.is_web(url), "not a web page").when(urls.is_private_host(url), "private network")
            .when(urls.domain_of(url).isNull(), "not listed"))


def first_outside_link(log: DataFrame) -> DataFrame:
    """The first link of each thread that leaves the post site and may be added."""
    h = urls.site_host("link")
    own = h.isin(POST_HOSTS)
    for site in POST_HOSTS:
        own = own | h.endswith("." + site)
    links = log.select("url", "seq", F.posexplode("links").alias("pos", "link"))
    return (links.where(urls.is_web("link") & ~own & refusal("link").isNull())
            .groupBy("url").agg(F.min_by("link", F.struct("seq", "pos")).alias("link")))
