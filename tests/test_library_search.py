"""Search over a small library: filters, the tail, cursors and what a hit says."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from pagelib.operators import library_search as ls
from pagelib.operators import search
from pagelib.plans.tables import Tables
from pagelib.operators.search import InvalidCursor

UTC = dt.timezone.utc
DAY = lambda n: dt.datetime(2024, 1, n, tzinfo=UTC)
PAGES = [(1, "https://a.example/river", "The River", ["Water", "en"], DAY(1), 1), (2, "https://b.example/sea", "Sea", ["water"], DAY(2), 2),
         (3, "https://a.example/stone", "Stone", ["rock"], DAY(3), 3), (4, "https://c.example/river-map", "Map", [], None, 4),
         (5, "https://a.example/none", "River without a body", ["water"], DAY(5), 5)]
BODIES = [(1, "x" * 90 + " a river runs here " + "y" * 300, "h1"), (2, "sea and river", "h2"), (3, "stones", "h3"), (4, "", "h4")]


@pytest.fixture(scope="module")
def shelf(spark):
    pages = spark.createDataFrame(PAGES, "id long, url string, title string, tags array<string>, added_at timestamp, pos long")
    return pages, spark.createDataFrame(BODIES, "id long, text string, content_sha256 string")


@pytest.fixture(scope="module")
def ranking(spark):
    v = spark.createDataFrame([(1, [0.6, 0.8]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "id long, vector array<double>")
    keyword = spark.createDataFrame([(2, 0.9), (1, 0.3)], "id long, score double")
    chunks = spark.createDataFrame([(1, 10, 91, 99, [1.0, 0.0], "h1"), (1, 11, 0, 5, [0.0, 1.0], "h1"), (2, 12, 0, 3, [0.0, 1.0], "old")],
                                   "page_id long, id long, start long, `end` long, vector array<double>, content_sha256 string")
    return ls.Ranking(F.array(F.lit(0.0), F.lit(1.0)), v, keyword, None, chunks)


def ids(hits):
    return [r.id for r in hits.orderBy("place").collect()]


def whole(shelf, ask, ranking=None, limit=100):
    return ls.result_page(ls.search_library(*shelf, ask, ranking), *shelf, limit)


def test_without_words_every_allowed_page_in_intake_order(shelf):
    assert ids(whole(shelf, ls.Ask()).hits) == [1, 2, 3, 4, 5]
    assert ids(whole(shelf, ls.Ask(tags=("WATER",))).hits) == [1, 2, 5]
    assert ids(whole(shelf, ls.Ask(domains=("A.example",), after="2024-01-02")).hits) == [3, 5]
    assert ids(whole(shelf, ls.Ask(after="2024-01-02T00:00:00+00:00", before="2024-01-05")).hits) == [2, 3]
    assert ids(whole(shelf, ls.Ask(kinds=("git",))).hits) == []
    with pytest.raises(ValueError):
        ls.search_library(*shelf, ls.Ask(after="2024-02-01", before="2024-01-01"))
    with pytest.raises(ValueError):
        ls.search_library(*shelf, ls.Ask(mode="guess"))


def test_keyword_mode_and_fields(shelf, ranking):
    for given in (whole(shelf, ls.Ask("RIVER"), None), whole(shelf, ls.Ask("river", mode="keyword"), ranking)):
        rows = given.hits.orderBy("place").collect()
        assert [(r.id, r.matched, r.ranked) for r in rows] == [(1, "title,url,text", False), (2, "text", False), (4, "url", False), (5, "title", False)]
        assert given.about.first().ranking == "keyword" and rows[0].chunk_status is None
        assert rows[0].snippet.startswith("…") and "a river runs" in rows[0].snippet and rows[0].snippet.endswith("…")
        assert rows[2].snippet is None and rows[3].snippet is None


def test_ranked_pages_come_first_and_chunks_of_old_bodies_do_not_count(shelf, ranking):
    found = ls.search_library(*shelf, ls.Ask("river"), ranking)
    page = ls.result_page(found, *shelf, 100)
    rows = {r.id: r for r in page.hits.collect()}
    # By vector 1 (its chunk 11) and 3 are equal, 2 keeps its own; by keyword 2 leads 1.
    assert ids(page.hits) == [1, 2, 3, 4, 5] and [rows[i].ranked for i in (1, 2, 3, 4, 5)] == [True, True, True, False, False]
    assert (rows[1].chunk_status, rows[1].chunk_start, rows[1].snippet) == ("ready", 0, "xxxxx")
    assert (rows[2].chunk_status, rows[2].chunk_start) == ("stale", None) and rows[3].chunk_status == "missing"
    assert {r.code: r.affected_pages for r in found.fallback.collect()} == {"chunks_stale": 1, "chunks_missing": 3}


def test_pages_by_cursor(spark, shelf, ranking):
    found = ls.search_library(*shelf, ls.Ask("river"), ranking)
    seen, cursor = [], None
    for returned, truncated in ((2, True), (2, True), (1, False)):
        page = ls.result_page(found, *shelf, 2, cursor)
        about = page.about.first()
        assert (about.total, about.returned, about.truncated, about.stale) == (5, returned, truncated, False)
        seen += ids(page.hits)
        cursor = about.next
    assert seen == [1, 2, 3, 4, 5] and cursor is None
    given = ls.result_page(found, *shelf, 2).about.first().next
    for other in (ls.search_library(*shelf, ls.Ask("river", tags=("water",)), ranking), ls.search_library(*shelf, ls.Ask("river", mode="keyword"), ranking),
                  ls.search_library(shelf[0].where("id <> 4"), shelf[1], ls.Ask("river"), ranking)):
        page = ls.result_page(other, *shelf, 2, given)
        assert page.about.first().stale and ids(page.hits) == []
    digest = given.split(":")[2]
    assert ls.result_page(found, *shelf, 2, f"v1:6:{digest}").about.first().stale
    assert ids(ls.result_page(found, *shelf, 2, f"v1:5:{digest}").hits) == []
    for bad in ("", "v1:2", f"v2:2:{digest}", f"v1:-1:{digest}", f"v1:2:{digest.upper()}", f"v1:2:{digest}0"):
        if bad.upper() == bad and digest.upper() == digest:
            continue
        with pytest.raises(InvalidCursor):
            ls.result_page(found, *shelf, 2, bad)


def test_capture_status_and_an_empty_library(spark, shelf):
    capture = spark.createDataFrame([("https://a.example/river", "ok"), ("https://b.example/sea", "thin")], "url string, status string")
    found = ls.search_library(*shelf, ls.Ask("river"))
    rows = {r.id: r.capture_status for r in ls.result_page(found, *shelf, 9, None, capture).hits.collect()}
    assert rows == {1: "ok", 2: "thin", 4: None, 5: None}
    none = (shelf[0].limit(0), shelf[1])
    page = ls.result_page(ls.search_library(*none, ls.Ask("river")), *none, 9)
    assert ids(page.hits) == [] and page.about.first().total == 0


def test_bodies_are_read_for_one_page_only(shelf, ranking):
    found = ls.search_library(*shelf, ls.Ask("river"), ranking)
    assert set(found.places.columns) == {"id", "place", "ranked"}
    plan = ls.result_page(found, *shelf, 2).hits._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_words_are_looked_for_where_a_text_lies(spark, shelf):
    pages, bodies = shelf
    for query in ("river", "RIVER sea", "", "stone x", "none"):
        whole_rows = search.keyword_match(pages.join(bodies.select("id", "text"), "id", "left"), query).select("id", "matched")
        apart = search.keyword_match_apart(pages, bodies, query)
        assert sorted(map(tuple, apart.collect())) == sorted(map(tuple, whole_rows.collect()))


def test_no_text_is_moved_to_join_pages(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)      # as where both sides are large
    try:
        plan = search.keyword_match_apart(t.search_docs(), t.texts(), "th on en")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    moved = [lines[i + 1] for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert len(moved) >= 3
    # What is moved is a flag or a title of a text (inside a call), never the column itself.
    assert not any(re.search(r"(?<!\()\btext#\d+", line) for line in moved), moved
