"""Logs and visits made from events and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelib.operators import logs, visits
from pagelib.plans.registry import query
from pagelib.plans.tables import SQL_VIEWS, Tables

micros = F.unix_micros

SQL_VIEWS["latest_content"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq DESC) AS rn FROM content_log) WHERE rn = 1"""


@query("latest_by_key", "SELECT url, seq, status, tier, reason, chars, content_sha256 FROM latest_content")
def _latest(t):
    return logs.latest_by_key(t.content_log()).select("url", "seq", "status", "tier", "reason", "chars",
                                                      "content_sha256")


SQL_VIEWS["settled"] = """
SELECT *, (seq_in_key - coalesce(last_other, 0) - 1) % 3 + 1 AS attempt FROM (
  SELECT *, max(CASE WHEN status <> 'error' THEN seq_in_key END) OVER (PARTITION BY url ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_other
  FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS seq_in_key FROM content_log))"""


@query("attempt_numbers", """
SELECT url, seq, attempt, CASE WHEN status = 'error' AND attempt >= 3 THEN 'unavailable' ELSE status END AS settled_status,
  CASE WHEN status = 'error' AND attempt >= 3 THEN coalesce(reason, '') || '; failed on ' || attempt || ' runs'
    ELSE reason END AS settled_reason FROM settled""")
def _attempts(t):
    return logs.attempt_numbers(t.content_log()).select("url", "seq", "attempt", "settled_status", "settled_reason")


@query("status_counts", "SELECT status, count(*) AS pages FROM latest_content GROUP BY status")
def _status_counts(t):
    return logs.status_counts(t.content_log())


@query("status_reasons", """
SELECT status, coalesce(reason, '') AS reason, count(*) AS pages FROM latest_content WHERE status <> 'ok' GROUP BY 1, 2""")
def _status_reasons(t):
    return logs.status_reasons(t.content_log())


@query("duration_spread", """
SELECT (SELECT value FROM (SELECT value, row_number() OVER (ORDER BY value) AS rn FROM events)
  WHERE rn = (SELECT count(*) // 2 + 1 FROM events)) AS median, (SELECT max(value) FROM events) AS longest""")
def _spread(t):
    return logs.duration_spread(t.raw("events"), "value")


SQL_VIEWS["marks"] = """
SELECT m.*, bookmarked_at FROM (
  SELECT url, 'clicked' AS kind, value, row_number() OVER (PARTITION BY url ORDER BY a DESC, s DESC) AS place FROM
    (SELECT url, post AS value, max(clicked_at) AS a, arg_max(seq, (clicked_at, seq)) AS s FROM bookmark_log
     WHERE post IS NOT NULL GROUP BY 1, 2)
  UNION ALL SELECT url, 'thread', value, row_number() OVER (PARTITION BY url ORDER BY k) FROM
    (SELECT url, value, min(seq * 2 + pos) AS k FROM (SELECT url, seq, unnest(posts) AS value, unnest([0, 1]) AS pos
     FROM bookmark_log) GROUP BY 1, 2)
  UNION ALL SELECT url, 'link', value, row_number() OVER (PARTITION BY url ORDER BY k) FROM
    (SELECT url, links[1] AS value, min(seq) AS k FROM bookmark_log GROUP BY 1, 2)) m
JOIN (SELECT url, max(clicked_at) AS bookmarked_at FROM bookmark_log WHERE post IS NOT NULL GROUP BY url) USING (url)"""


@query("bookmark_fold", "SELECT url, kind, value, place, epoch_us(bookmarked_at) AS bookmarked_at FROM marks")
def _bookmarks(t):
    return logs.bookmark_fold(t.bookmark_log()).withColumn("bookmarked_at", micros("bookmarked_at"))


@query("linked_from", "SELECT value AS url, url AS linked_from FROM marks WHERE kind = 'link'")
def _linked(t):
    return logs.linked_from(t.bookmark_log())


@query("thread_page", """
WITH asked AS (SELECT event_id AS ask, unnest([(event_id % 40)::VARCHAR, (event_id % 57 + 20)::VARCHAR]) AS post FROM events)
SELECT ask, arg_max(url, (bookmarked_at, url)) AS url FROM asked JOIN marks ON value = post AND kind = 'thread' GROUP BY ask""")
def _thread_page(t):
    e = F.col("event_id")
    asked = t.raw("events").select(e.alias("ask"), F.explode(F.array(
        (e % 40).cast("string"), (e % 57 + 20).cast("string"))).alias("post"))
    return logs.thread_page(t.bookmark_log(), asked)


@query("first_outside_link", """
SELECT url, arg_min(link, (seq, pos)) AS link FROM (SELECT url, seq, unnest(range(3)) AS pos,
  unnest(['https://t.co/x', 'http://box.local/', links[1]]) AS link FROM bookmark_log)
WHERE link NOT IN ('https://t.co/x', 'http://box.local/') GROUP BY url""")
def _outside(t):
    log = t.bookmark_log().withColumn("links", F.concat(
        F.array(F.lit("https://t.co/x"), F.lit("http://box.local/")), "links"))
    return logs.first_outside_link(log)


# --- visits

@query("visit_rollup", """
SELECT url_id, epoch_us(min(visit_time)) AS first_visit,
  floor(sum(foreground_micros) FILTER (foreground_micros > 0) / 1000000)::BIGINT AS foreground_seconds
FROM visits GROUP BY url_id""")
def _rollup(t):
    return visits.visit_rollup(t.visits()).withColumn("first_visit", micros("first_visit"))


SQL_VIEWS["links_back"] = """
SELECT id AS child, from_visit AS parent FROM visits WHERE from_visit IS NOT NULL
UNION SELECT id, opener_visit FROM visits WHERE opener_visit IS NOT NULL"""
SQL_VIEWS["hop1"] = "SELECT v.url_id, l.parent AS id FROM visits v JOIN links_back l ON l.child = v.id"
SQL_VIEWS["hop2"] = "SELECT DISTINCT h.url_id, l.parent AS id FROM hop1 h JOIN links_back l ON l.child = h.id"
SQL_VIEWS["hop3"] = "SELECT DISTINCT h.url_id, l.parent AS id FROM hop2 h JOIN links_back l ON l.child = h.id"
SQL_VIEWS["nearest_search"] = """
SELECT url_id, arg_max(term, (-hops, visit_time, term)) AS term, min(hops)::BIGINT AS hops FROM (
  SELECT a.url_id, a.hops, v.visit_time, s.term FROM (
    SELECT url_id, id, 0 AS hops FROM visits UNION ALL SELECT url_id, id, 1 FROM hop1
    UNION ALL SELECT url_id, id, 2 FROM hop2 UNION ALL SELECT url_id, id, 3 FROM hop3) a
  JOIN visits v ON v.id = a.id JOIN search_terms s ON s.url_id = v.url_id) GROUP BY url_id"""
SQL_VIEWS["came_from"] = """
SELECT url_id, coalesce(inside, outside) AS referrer FROM (
  SELECT c.url_id, arg_max(u.url, (c.visit_time, l.parent = c.from_visit, l.parent)) AS inside
  FROM visits c JOIN links_back l ON l.child = c.id JOIN visits p ON p.id = l.parent AND p.url_id <> c.url_id
  JOIN visit_urls u ON u.id = p.url_id GROUP BY c.url_id)
FULL JOIN (SELECT url_id, arg_max(external_referrer_url, (visit_time, id)) AS outside FROM visits
  WHERE external_referrer_url IS NOT NULL GROUP BY url_id) USING (url_id)"""


@query("search_ancestry", "SELECT * FROM nearest_search")
def _ancestry(t):
    return visits.search_ancestry(t.visits(), t.search_terms())


@query("referrer_of", "SELECT * FROM came_from")
def _referrer(t):
    return visits.referrer_of(t.visits(), t.visit_urls())


SQL_VIEWS["signals"] = """
SELECT url, visit_count AS visits, typed_count AS typed, epoch_us(last_visit_time) AS last_visit,
  epoch_us(first_visit) AS first_visit, foreground_seconds, term, hops, referrer
FROM visit_urls u LEFT JOIN (SELECT url_id, min(visit_time) AS first_visit,
    floor(sum(foreground_micros) FILTER (foreground_micros > 0) / 1000000)::BIGINT AS foreground_seconds
    FROM visits GROUP BY url_id) r ON r.url_id = u.id
LEFT JOIN nearest_search s ON s.url_id = u.id LEFT JOIN came_from c ON c.url_id = u.id
WHERE last_visit_time IS NOT NULL"""


def signals(t: Tables):
    s = visits.visit_signals(t.visit_urls(), t.visits(), t.search_terms())
    return s.withColumns({"last_visit": micros("last_visit"), "first_visit": micros("first_visit")})


@query("visit_signals", "SELECT * FROM signals")
def _signals(t):
    return signals(t)


SQL_VIEWS["merged_history"] = """
SELECT coalesce(p.url, n.url) AS url, coalesce(n.visits, p.visits) AS visits,
  CASE WHEN n.url IS NOT NULL THEN 2000 ELSE p.refreshed END AS refreshed,
  CASE WHEN n.url IS NOT NULL THEN 'found' WHEN w THEN 'kept' ELSE 'untouched' END AS outcome
FROM (SELECT url, -page_id AS visits, 1000 AS refreshed, page_id % 2 = 0 AS w FROM pages WHERE page_id % 3 <> 0) p
FULL JOIN (SELECT u.url, visit_count AS visits FROM visit_urls u WHERE last_visit_time IS NOT NULL AND id % 2 = 0
  AND id % 5 <> 0) n USING (url)"""


def _merged(t: Tables):
    pages = t.raw("pages").select("page_id", "url")
    previous = pages.where("page_id % 3 <> 0").select(
        "url", F.struct((-F.col("page_id")).alias("visits")).alias("signals"),
        F.timestamp_seconds(F.lit(1000)).alias("refreshed_at"))
    # Of an address with several rows the one visited last, as in `visit_signals`.
    reading = t.visit_urls().where("last_visit_time is not null and id % 5 <> 0").groupBy("url").agg(
        F.max_by(F.struct(F.col("visit_count").alias("visits")), F.struct("last_visit_time", "id")).alias("signals"))
    wanted = pages.where("page_id % 2 = 0").select("url")
    return visits.history_merge(previous, reading, wanted, F.timestamp_seconds(F.lit(2000)))


@query("history_merge", "SELECT url, visits, refreshed::BIGINT AS refreshed, outcome FROM merged_history")
def _history_merge(t):
    return _merged(t).select("url", "signals.visits", F.unix_seconds("refreshed_at").alias("refreshed"), "outcome")


@query("history_counts", """
SELECT count(*) FILTER (outcome = 'found') AS found, count(*) FILTER (outcome = 'kept') AS kept,
  count(*) AS recorded FROM merged_history""")
def _history_counts(t):
    return visits.history_counts(_merged(t))


@query("history_status", """
SELECT count(*) AS pages, count(*) FILTER (refreshed < (SELECT max(refreshed) FROM merged_history)) AS not_in_history
FROM merged_history""")
def _history_status(t):
    return visits.history_status(_merged(t))


@query("page_history", """
WITH carried AS (SELECT url, arg_max(tab_id, captured_at * 1) AS visits FROM (SELECT url, max(tab_id) AS tab_id,
  epoch_us(captured_at) AS captured_at FROM sightings WHERE tab_id % 3 = 0 GROUP BY url, captured_at) GROUP BY url)
SELECT p.url, coalesce(u.visit_count, c.visits) AS visits FROM site_pages p
LEFT JOIN (SELECT * FROM visit_urls WHERE id % 2 = 0) u USING (url) LEFT JOIN carried c USING (url)""")
def _page_history(t):
    from pagelib.operators.library import page_history
    recorded = t.visit_urls().where("id % 2 = 0").select(
        "url", F.struct(F.col("visit_count").alias("visits")).alias("signals"))
    carried = (t.sightings().where("tab_id % 3 = 0").groupBy("url", "captured_at")
               .agg(F.struct(F.max("tab_id").alias("visits")).alias("signals")))
    return page_history(t.site_pages(), recorded, carried).select("url", "history.visits")
