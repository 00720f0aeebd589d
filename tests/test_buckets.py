"""Orders stay in small buckets when most rows share a day, a score or a count."""

import datetime as dt

from pyspark.sql import functions as F

from pagelib.functions import html_facts, ordered
from pagelib.operators import library, planning, search


def largest(monkeypatch, call):
    """The rows of the largest bucket that `call` windows."""
    seen = []
    own = ordered._bucketed

    def watched(df, coarse):
        out = own(df, coarse)
        seen.append(out[0].groupBy(*out[1]).count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(ordered, "_bucketed", watched)
    call().collect()
    return max(seen)


def test_orders_of_a_library_seen_in_one_snapshot(spark, monkeypatch):
    at = dt.datetime(2026, 1, 1)
    rows = [(f"https://www.example.com/{i:05}", f"Page {i:05}", at, at, 1, "s9", "s9", i % 20, i // 20, None if i % 10 else i) for i in range(6000)]
    pages = spark.createDataFrame(rows, "url string, title string, first_seen timestamp, last_seen timestamp, times_seen int, last_snapshot string, "
                                        "first_snapshot string, last_window int, last_position int, rank int")
    for by in ("last", "first", "count", "url", "relevance"):
        assert largest(monkeypatch, lambda: library.place_pages(pages, by)) <= 1024, by


def test_plan_and_fused_order(spark, monkeypatch):
    at = dt.datetime(2026, 1, 1)
    plan = spark.createDataFrame([(f"u{i}", (at, "b", 1, i % 20, i // 20)) for i in range(6000)],
                                 "url string, seen struct<captured_at: timestamp, base: string, ordinal: int, window: int, position: int>")
    assert largest(monkeypatch, lambda: planning.numbered(plan)) <= 1024


def largest_range(df, order):
    """Share of the rows in the largest range, where small ones are not joined."""
    df.sparkSession.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return share_of_largest(df, order)
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def share_of_largest(df, order):
    sizes = [r["count"] for r in ordered.ranges(df, order).groupBy(F.shiftright("__at", ordered.PLACE_BITS)).count().collect()]
    return max(sizes) / sum(sizes)


def test_ranks_of_a_million_pages(spark):
    """Fused scores of ranks crowd at 0: 1 / (60 + rank)."""
    fused = spark.range(1_000_000).select("id", F.round(1 / (61 + F.pmod(F.col("id") * 7919, F.lit(1_000_000))), 12).alias("fused"))
    assert largest_range(fused, [F.desc("fused"), F.asc("id")]) < 0.2      # of eight ranges
    got = search.fused_order(fused).agg(F.count("*").alias("n"), F.countDistinct("place").alias("d"), F.min("place"), F.max("place"),
                                        F.sum((F.col("place") == F.pmod(F.col("id") * 7919, F.lit(1_000_000)) + 1).cast("int")).alias("same")).first()
    assert tuple(got)[:4] == (1_000_000, 1_000_000, 1, 1_000_000) and got["same"] > 900_000      # far ranks share rounded scores


def test_ranks_where_most_scores_are_equal(spark):
    scores = spark.range(100_000).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("id"),
                                         F.when(F.col("id") % 10 == 0, F.col("id") / 1e5).otherwise(0.25).alias("score"))
    assert largest_range(scores, [F.desc("score"), F.asc("id")]) < 0.2
    want = [r.id for r in scores.orderBy(F.desc("score"), F.asc("id")).collect()]
    assert [r.id for r in search.rank_source(scores).orderBy("rank").collect()] == want
    assert search.rank_source(scores.limit(0)).collect() == []


def test_pages_with_containers_and_implied_ends():
    page = '<div role="navigation">menu</div><p>Body text one.</p><img src="/a.png">'
    assert html_facts.facts(page)["page"] == "Body text one." and len(html_facts.facts(page)["images"]) == 1
    assert html_facts.facts("<ul><li hidden>x<li>shown</ul><p>rest of page</p>")["visible"] == "shown rest of page"
    assert html_facts.facts("<table><tr><td hidden>a<td>b<tr><td>c</table>d")["visible"] == "b c d"
    assert html_facts.facts("<head><title>T</title><p>after")["page"] == "after"
    assert html_facts.facts("</div></p>text<nav><p>m</nav> more")["page"].split() == ["text", "more"]
