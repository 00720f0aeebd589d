"""Library questions over the sightings made from events and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelib.functions import ordered, text
from pagelib.functions.ordered import Coarse
from pagelib.operators import library as lib
from pagelib.plans.registry import query
from pagelib.plans.tables import SQL_VIEWS, Tables
from pagelib.session import materialise

micros = lambda c: F.unix_micros(c)

# Page hosts need no user info, port or IPv6 rules, so the twin reads them by a short pattern.
SQL_VIEWS["placed"] = """
SELECT * REPLACE (row_number() OVER (PARTITION BY snapshot_id, "window"
  ORDER BY position < 0, position, tab_id) - 1 AS position) FROM sightings"""
_DOMAIN = "regexp_replace(regexp_extract(url, '^https?://([^/?#:]*)', 1), '^www\\.', '')"
SQL_VIEWS["lib_pages"] = f"""
SELECT url, coalesce(arg_max(title, (captured_at, "window", position)) FILTER (trim(title) <> ''), '') AS title,
  {_DOMAIN} AS domain, min(captured_at) AS first_seen, max(captured_at) AS last_seen,
  count(DISTINCT snapshot_id) AS times_seen, count(*) AS sightings,
  max(snapshot_id) = (SELECT max(snapshot_id) FROM sightings) AS open,
  min(snapshot_id) AS first_snapshot, max(snapshot_id) AS last_snapshot,
  arg_max("window", (captured_at, "window", position)) AS last_window,
  arg_max(position, (captured_at, "window", position)) AS last_position,
  arg_min("group", ("window", position)) FILTER ("group" IS NOT NULL AND captured_at = newest) AS last_group
FROM (SELECT *, max(captured_at) OVER (PARTITION BY url) AS newest FROM placed) GROUP BY url"""
SQL_VIEWS["kept_pages"] = "SELECT * FROM lib_pages WHERE url NOT IN (SELECT url FROM forgotten)"


def pages_of(t: Tables, forget: bool = True):
    return lib.library_pages(t.sightings(), t.forgotten() if forget else None)


@query("library_pages", """
SELECT url, title, domain, epoch_us(first_seen) AS first_seen, epoch_us(last_seen) AS last_seen, times_seen,
  sightings, open, last_window, last_position, last_group FROM kept_pages
ORDER BY last_seen DESC, last_snapshot DESC, last_window, last_position""")
def _library_pages(t):
    p = lib.sort_pages(pages_of(t), "last")
    return p.select("url", "title", "domain", micros("first_seen").alias("first_seen"),
                    micros("last_seen").alias("last_seen"), "times_seen", "sightings", "open", "last_window",
                    "last_position", "last_group")


@query("order_snapshots", """
WITH ids AS (SELECT event_id, date_trunc('minute', ts)::TIMESTAMP AS captured_at, event_id % 12 AS k,
  strftime(ts, '%Y%m%dT%H%M00Z') AS base FROM events)
SELECT event_id, row_number() OVER (ORDER BY captured_at, base, greatest(k, 1), event_id) AS place FROM ids""")
def _order_snapshots(t):
    k = F.col("event_id") % 12
    ids = t.raw("events").select("event_id", F.date_trunc("minute", "ts").alias("captured_at"), F.concat(
        F.date_format("ts", "yyyyMMdd'T'HHmm00'Z'"),
        F.when(k > 1, F.concat(F.lit("-"), k.cast("string"))).otherwise("")).alias("id"))
    return ordered.row_number(ids, [], [F.col("captured_at"), *lib.snapshot_order("id"), F.col("event_id")],
                              [Coarse(F.date_trunc("hour", "captured_at"))], "place").select("event_id", "place")


@query("renumber_positions", "SELECT tab_id, snapshot_id, \"window\", position FROM placed")
def _renumber(t):
    return lib.renumber_positions(t.sightings()).select("tab_id", "snapshot_id", "window", "position")


@query("listed_tabs", f"""
SELECT snapshot_id, count(*) AS tabs, count(DISTINCT {_DOMAIN}) AS domains FROM local_sightings
WHERE url NOT LIKE 'http://localhost%' GROUP BY snapshot_id""")
def _listed(t):
    return lib.listed(t.local_sightings()).groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("tabs"), F.countDistinct("domain").alias("domains"))


@query("known_urls", "SELECT DISTINCT url FROM local_sightings WHERE url NOT LIKE 'http://localhost%'")
def _known(t):
    return lib.known_urls(t.local_sightings())


@query("history_candidates", """
SELECT DISTINCT url FROM local_sightings WHERE url NOT LIKE 'http://localhost%'
  AND url NOT IN (SELECT url FROM forgotten)""")
def _candidates(t):
    return lib.history_candidates(t.local_sightings(), t.forgotten())


SQL_VIEWS["local_windows"] = """
SELECT snapshot_id, "window" AS number, max(CASE WHEN active THEN tab_id END) AS active_tab, count(*) AS tabs
FROM local_sightings GROUP BY 1, 2"""
SQL_VIEWS["local_groups"] = """
SELECT snapshot_id, coalesce("group", 'loose') || CASE WHEN "window" = 1 THEN '' ELSE '' END AS id,
  min("window") AS "window" FROM local_sightings GROUP BY 1, 2"""
# A snapshot without tabs on this machine stays exactly as it was.
SQL_VIEWS["touched_snapshots"] = "SELECT DISTINCT snapshot_id FROM local_sightings WHERE url LIKE 'http://localhost%'"
SQL_VIEWS["clean_windows"] = """
SELECT w.*, snapshot_id IN (SELECT snapshot_id FROM touched_snapshots) AS touched, CASE WHEN snapshot_id IN
  (SELECT snapshot_id FROM touched_snapshots) THEN row_number() OVER (PARTITION BY snapshot_id ORDER BY number) ELSE number END AS new_number
FROM local_windows w
WHERE EXISTS (SELECT 1 FROM local_sightings s WHERE s.snapshot_id = w.snapshot_id AND s."window" = w.number
  AND s.url NOT LIKE 'http://localhost%')"""


def _parts(t):
    s = t.local_sightings()
    windows = s.groupBy("snapshot_id", F.col("window").alias("number")).agg(
        F.max(F.when(F.col("active"), F.col("tab_id"))).alias("active_tab"), F.count(F.lit(1)).alias("tabs"))
    groups = s.groupBy("snapshot_id", F.coalesce("group", F.lit("loose")).alias("id")).agg(
        F.min("window").alias("window"))
    return lib.exclude_this_machine(s, windows, groups)


@query("exclude_this_machine", """
SELECT snapshot_id, tab_id, new_number AS "window", CASE WHEN position < 0 OR NOT touched THEN position ELSE
  row_number() OVER (PARTITION BY snapshot_id, new_number, position < 0 ORDER BY position, tab_id) - 1 END AS position
FROM local_sightings JOIN clean_windows w USING (snapshot_id)
WHERE w.number = "window" AND url NOT LIKE 'http://localhost%'""")
def _exclude(t):
    return _parts(t)["tabs"].select("snapshot_id", "tab_id", "window", "position")


@query("exclude_this_machine_windows", """
SELECT c.snapshot_id, c.new_number AS number, (SELECT count(*) FROM local_sightings s
    WHERE s.snapshot_id = c.snapshot_id AND s."window" = c.number AND s.url NOT LIKE 'http://localhost%') AS tabs,
  CASE WHEN active_tab % 29 <> 0 THEN active_tab END AS active_tab FROM clean_windows c""")
def _exclude_windows(t):
    return _parts(t)["windows"]


@query("exclude_this_machine_stats", """
SELECT s.snapshot_id, (SELECT count(*) FROM clean_windows c WHERE c.snapshot_id = s.snapshot_id) AS windows,
  count(*) FILTER (url NOT LIKE 'http://localhost%') AS tabs,
  CASE WHEN s.snapshot_id IN (SELECT snapshot_id FROM touched_snapshots) THEN count(DISTINCT "group") FILTER (url NOT LIKE 'http://localhost%')
    ELSE count(DISTINCT coalesce("group", 'loose')) END AS groups,
  count(*) FILTER (url LIKE 'http://localhost%') AS excluded_tabs
FROM local_sightings s GROUP BY s.snapshot_id""")
def _exclude_stats(t):
    return _parts(t)["stats"]


@query("sighting_groups", """
SELECT snapshot_id, coalesce(upper("group"), '-') AS group_title,
  CASE "group" WHEN 'click' THEN 'blue' WHEN 'view' THEN 'grey' ELSE '-' END AS group_colour, count(*) AS tabs
FROM sightings GROUP BY ALL""")
def _sighting_groups(t):
    s = t.sightings()
    code = F.when(F.col("id") == "click", 1).otherwise(0)
    g = (s.where("group is not null").groupBy("snapshot_id", F.col("group").alias("id"))
         .agg(F.upper(F.first("group")).alias("title")).withColumn("colour", text.decode_colour(code)))
    return lib.sighting_groups(s, g).groupBy(
        "snapshot_id", F.coalesce("group_title", F.lit("-")).alias("group_title"),
        F.coalesce("group_colour", F.lit("-")).alias("group_colour")).agg(F.count(F.lit(1)).alias("tabs"))


@query("library_stats", f"""
SELECT (SELECT count(*) FROM kept_pages) AS pages, (SELECT count(DISTINCT domain) FROM kept_pages) AS domains,
  (SELECT sum(sightings)::BIGINT FROM kept_pages) AS sightings,
  (SELECT count(*) FROM lib_pages WHERE url IN (SELECT url FROM forgotten)) AS forgotten,
  (SELECT count(DISTINCT snapshot_id) FROM sightings) AS snapshots""")
def _stats(t):
    return lib.library_stats(t.sightings(), t.forgotten())


_SUMMARY = """concat_ws(', ', CASE WHEN unknown_commands > 0 THEN unknown_commands || ' unknown commands (ids )' END,
  CASE WHEN malformed_commands > 0 THEN malformed_commands || ' malformed commands' END,
  CASE WHEN truncated_bytes > 0 THEN truncated_bytes || ' trailing bytes unparsed' END,
  CASE WHEN dropped_tabs > 0 THEN dropped_tabs || ' tabs dropped' END,
  CASE WHEN navigation_fallbacks > 0 THEN navigation_fallbacks || ' navigation fallbacks' END,
  CASE WHEN groups_without_metadata > 0 THEN groups_without_metadata || ' groups without metadata' END,
  CASE WHEN marker_count <> 1 THEN marker_count || ' state markers (expected 1)' END)"""


@query("snapshot_degraded",
       f"SELECT snapshot_id, {_SUMMARY} AS summary, {_SUMMARY} <> '' AS degraded FROM snapshot_stats")
def _degraded(t):
    return lib.snapshot_degraded(t.snapshot_stats())


@query("snapshot_list", f"""
SELECT s.snapshot_id, epoch_us(max(captured_at)) AS captured_at, count(*) AS tabs, count(DISTINCT "window") AS windows,
  count(DISTINCT "group") AS groups, any_value(summary) AS summary, any_value(summary) <> '' AS degraded
FROM sightings s JOIN (SELECT snapshot_id, {_SUMMARY} AS summary FROM snapshot_stats) d USING (snapshot_id)
GROUP BY s.snapshot_id""")
def _snapshot_list(t):
    return lib.snapshot_list(t.sightings(), t.snapshot_stats()).withColumn("captured_at", micros("captured_at"))


@query("layout_digest", """
WITH h AS (SELECT snapshot_id, sha256(concat_ws(chr(31), "window"::VARCHAR, position::VARCHAR, url,
  pinned::VARCHAR, coalesce("group", chr(0)))) AS h FROM sightings)
SELECT snapshot_id, sha256(concat_ws(':', count(*)::VARCHAR,
  sum(('0x' || h[1:15])::BIGINT::HUGEINT)::VARCHAR, sum(('0x' || h[16:30])::BIGINT::HUGEINT)::VARCHAR,
  sum(('0x' || h[31:45])::BIGINT::HUGEINT)::VARCHAR, sum(('0x' || h[46:60])::BIGINT::HUGEINT)::VARCHAR)) AS digest
FROM h GROUP BY snapshot_id""")
def _layout(t):
    return lib.layout_digest(t.sightings())


@query("unchanged_snapshots", """
SELECT id, previous, coalesce(previous = digest, false) AS unchanged FROM (SELECT *, lag(digest) OVER (
  PARTITION BY browser, profile ORDER BY captured_at, id) AS previous FROM captures)""")
def _unchanged(t):
    return lib.unchanged_snapshots(t.captures()).select("id", "previous", "unchanged")


SQL_VIEWS["intake"] = """
SELECT url, row_number() OVER (ORDER BY first_seq) AS tab_id, coalesce(title, '') AS title, added_at
FROM (SELECT url, min(seq) AS first_seq, arg_max(struct_pack(t := title), seq).t AS title,
  arg_max(added_at, seq) AS added_at FROM added GROUP BY url)"""


@query("intake_fold", """
SELECT 'added' AS snapshot_id, epoch_us((SELECT min(added_at) FROM added)) AS captured_at, tab_id - 1 AS position,
  tab_id, url, title, epoch_us(added_at) AS added_at FROM intake""")
def _intake(t):
    return lib.intake_fold(t.added()).withColumns({"captured_at": micros("captured_at"),
                                                   "added_at": micros("added_at")}).drop("window")


@query("with_intake", """
SELECT snapshot_id, count(*) AS tabs, count(DISTINCT url) AS pages FROM
 (SELECT snapshot_id, url FROM sightings UNION ALL SELECT 'added', url FROM intake) GROUP BY 1""")
def _with_intake(t):
    return lib.with_intake(t.sightings(), t.added()).groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("tabs"), F.countDistinct("url").alias("pages"))


@query("first_last_seen", """
SELECT url, epoch_us(min(seen)) AS first_seen, epoch_us(max(seen)) AS last_seen FROM
 (SELECT url, captured_at AS seen FROM sightings UNION ALL SELECT url, added_at FROM intake) GROUP BY url""")
def _first_last(t):
    s = lib.first_last_seen(lib.with_intake(t.sightings(), t.added()))
    return s.select("url", micros("first_seen").alias("first_seen"), micros("last_seen").alias("last_seen"))


@query("library_with_intake", """
WITH last_seen AS (SELECT url, count(DISTINCT snapshot_id) AS times_seen,
  bool_or(snapshot_id = (SELECT max(snapshot_id) FROM sightings)) AS open FROM
  (SELECT snapshot_id, url FROM sightings UNION ALL SELECT 'added', url FROM intake) GROUP BY url)
SELECT * FROM last_seen""")
def _library_intake(t):
    return lib.library_pages(lib.with_intake(t.sightings(), t.added())).select("url", "times_seen", "open")


@query("snapshot_flow", """
SELECT s AS snapshot_id, sum(f)::BIGINT AS fresh, sum(g)::BIGINT AS gone FROM (
  SELECT first_snapshot AS s, 1 AS f, 0 AS g FROM kept_pages
  UNION ALL SELECT last_snapshot, 0, 1 FROM kept_pages WHERE NOT open) GROUP BY s""")
def _flow(t):
    return lib.snapshot_flow(pages_of(t))


@query("sighting_strip", """
WITH snaps AS (SELECT snapshot_id, (row_number() OVER (ORDER BY snapshot_id) - 1) AS k,
    count(*) OVER () AS n FROM (SELECT DISTINCT snapshot_id FROM sightings)),
runs AS (SELECT snapshot_id, k * least(12, n) // n AS cell FROM snaps)
SELECT url, cell, count(DISTINCT snapshot_id) / (SELECT count(*) FROM runs c WHERE c.cell = x.cell) AS share
FROM sightings JOIN runs x USING (snapshot_id) GROUP BY url, cell""")
def _strip(t):
    return lib.sighting_strip(t.sightings(), 12)


@query("month_bands", """
SELECT CASE WHEN open THEN 'Open now' ELSE strftime(last_seen, '%Y-%m') END AS band, count(*) AS pages
FROM kept_pages GROUP BY 1""")
def _bands(t):
    return lib.month_bands(pages_of(t), "last").groupBy("band").agg(F.count(F.lit(1)).alias("pages"))


@query("newest_first", """
SELECT url, epoch_us(added_at) AS added_at FROM kept_pages LEFT JOIN (SELECT url, added_at FROM intake) USING (url)
ORDER BY added_at DESC NULLS LAST, url""")
def _newest(t):
    p = pages_of(t).join(lib.intake_fold(t.added()).select("url", "added_at"), "url", "left")
    return lib.newest_first(p).select("url", micros("added_at").alias("added_at"))


_SORTS = {
    "last": "last_seen DESC, last_snapshot DESC, last_window, last_position, url",
    "first": "first_seen DESC, first_snapshot DESC, last_window, last_position, url",
    "count": "times_seen DESC, last_snapshot DESC, last_window, url",
    "title": "lower(regexp_replace(CASE WHEN trim(title) = '' THEN url ELSE title END, '^[^\\p{L}\\p{N}]+', '')), "
             "last_snapshot DESC, url",
    "url": "url",
}


def _sort(by: str, order: str):
    @query(f"sort_pages_{by}", f"SELECT url, row_number() OVER (ORDER BY {order}) AS place FROM kept_pages")
    def run(t):
        # Numbering reads its input twice: the fold is written once.
        return lib.place_pages(materialise(pages_of(t), "pages"), by).select("url", "place")


for _by, _order in _SORTS.items():
    _sort(_by, _order)


@query("sort_pages_relevance", """
SELECT url, row_number() OVER (ORDER BY rank NULLS LAST, last_seen DESC, last_snapshot DESC, url) AS place FROM
 (SELECT *, CASE WHEN last_position % 3 <> 0 THEN last_position * 7 % 50 END AS rank FROM kept_pages)""")
def _sort_relevance(t):
    at = F.col("last_position")
    ranked = pages_of(t).withColumn("rank", F.when(at % 3 != 0, at * 7 % 50))
    return lib.place_pages(materialise(ranked, "pages"), "relevance").select("url", "place")


@query("limit_more", """
SELECT url, (SELECT greatest(count(*) - 40, 0) FROM kept_pages) AS more FROM
 (SELECT url FROM kept_pages ORDER BY last_seen DESC, last_snapshot DESC, last_window, last_position, url LIMIT 40)""")
def _limit_more(t):
    head, more = lib.limit_more(pages_of(t), 40, lib.sort_keys("last"))
    return head.select("url").withColumn("more", more.scalar())


SQL_VIEWS["faceted"] = """
SELECT p.*, p.url IN (SELECT url FROM forgotten) AS forgotten,
  coalesce((SELECT list(DISTINCT lower("group")) FROM sightings s WHERE s.url = p.url AND "group" IS NOT NULL), []) AS groups,
  coalesce((SELECT list(DISTINCT lower(name)) FROM page_tags g WHERE g.url = p.url AND side = 'add'), []) AS tags,
  p.url IN (SELECT url FROM suggested) AS has_suggested FROM lib_pages p"""


def faceted(t: Tables):
    """Pages with the lists the page view filters on; written once, as the filters read them several times."""
    p = lib.library_pages(t.sightings(), t.forgotten(), shape="serve")
    groups = t.sightings().where("group is not null").groupBy("url").agg(
        F.collect_set(F.lower("group")).alias("groups"))
    tags = t.page_tags().where("side = 'add'").groupBy("url").agg(F.collect_set(F.lower("name")).alias("tags"))
    answered = t.suggested().select("url").distinct().withColumn("has_suggested", F.lit(True))
    none = F.array().cast("array<string>")
    return materialise(p.join(groups, "url", "left").join(tags, "url", "left").join(answered, "url", "left")
                       .withColumns({"groups": F.coalesce("groups", none), "tags": F.coalesce("tags", none),
                                     "has_suggested": F.coalesce("has_suggested", F.lit(False))}), "faceted")


@query("facet_filter", """
SELECT url FROM faceted WHERE NOT forgotten AND contains(domain, 'example.com') AND list_contains(groups, 'view')
  AND NOT open AND list_contains(tags, 'en') AND contains(lower(title || ' ' || url), 'th')""")
def _facet_filter(t):
    return lib.facet_filter(faceted(t), q="TH", domain="example.com", group="View", status="closed",
                            tags=["EN"]).select("url")


@query("facets_domain", """
SELECT domain AS value, count(*) AS pages FROM faceted WHERE NOT forgotten AND domain <> ''
  AND contains(lower(title || ' ' || url), 'th') AND list_contains(groups, 'click') GROUP BY domain""")
def _facets_domain(t):
    return lib.facets(faceted(t), "domain", q="th", domain="nowhere", group="click")


@query("facets_group", """
SELECT g AS value, count(*) AS pages FROM (SELECT unnest(groups) AS g FROM faceted
  WHERE NOT forgotten AND open) GROUP BY g""")
def _facets_group(t):
    return lib.facets(faceted(t), "group", status="open", group="click")


@query("tag_cooccurrence", """
SELECT tag, count(*) AS pages FROM (SELECT unnest(tags) AS tag FROM faceted
  WHERE NOT forgotten AND list_contains(tags, 'en')) GROUP BY tag""")
def _cooccurrence(t):
    return lib.tag_cooccurrence(lib.facet_filter(faceted(t), tags=["en"]))


@query("search_filter", f"""
SELECT url FROM faceted JOIN (SELECT url, added_at FROM intake) USING (url)
WHERE list_contains(tags, 'en') AND {_DOMAIN} LIKE '%' AND regexp_matches(url, '^https?:')
  AND added_at >= TIMESTAMP '2024-01-05' AND added_at < TIMESTAMP '2024-01-25'""")
def _search_filter(t):
    import datetime as dt
    p = faceted(t).join(lib.intake_fold(t.added()).select("url", "added_at"), "url", "left")
    return lib.search_filter(p, tags=["EN"], kinds=["web"], after=dt.datetime(2024, 1, 5, tzinfo=dt.timezone.utc),
                             before=dt.datetime(2024, 1, 25, tzinfo=dt.timezone.utc)).select("url")


@query("forgotten_flag", """
SELECT page_id, variant, string_split(url, '#')[1] IN
  (SELECT string_split(url, '#')[1] FROM forgotten) AS covered FROM url_variants""")
def _forgotten_flag(t):
    return lib.forgotten_variants(t.url_variants(), t.forgotten()).select("page_id", "variant", "covered")


SQL_VIEWS["referred"] = """
SELECT p.url, p.title, CASE WHEN page_id % 9 = 0 THEN p.url WHEN page_id % 9 = 1 THEN 'http://localhost/' || page_id
  ELSE (SELECT any_value(q.url) FROM site_pages q WHERE q.page_id = (p.page_id * 3 + 1) % (SELECT count(*) FROM pages)) END
  AS referrer, 'term ' || page_id AS search FROM site_pages p"""


def referred(t: Tables):
    p = t.site_pages()
    to = F.col("page_id") * 3 + 1
    other = p.select(F.col("page_id").alias("to_id"), F.col("url").alias("other"))
    p = p.withColumn("to_id", to % t.count_of("pages")).join(other, "to_id")
    ref = (F.when(F.col("page_id") % 9 == 0, F.col("url"))
           .when(F.col("page_id") % 9 == 1, F.concat(F.lit("http://localhost/"), F.col("page_id").cast("string")))
           .otherwise(F.col("other")))
    return p.select("url", "title", ref.alias("referrer"),
                    F.concat(F.lit("term "), F.col("page_id").cast("string")).alias("search"))


@query("name_referrers", """
WITH ok AS (SELECT url, CASE WHEN referrer <> url AND referrer NOT LIKE 'http://localhost%' THEN referrer END AS referrer
  FROM referred)
SELECT ok.url, ok.referrer, r.title AS referrer_title FROM ok LEFT JOIN referred r ON r.url = ok.referrer
  AND trim(r.title) <> ''""")
def _name_referrers(t):
    return lib.name_referrers(referred(t)).select("url", "referrer", "referrer_title")


@query("export_privacy", """
SELECT url, CASE WHEN referrer <> url AND referrer NOT LIKE 'http://localhost%'
  AND referrer NOT IN (SELECT url FROM forgotten) THEN referrer END AS referrer, search
FROM referred WHERE url NOT IN (SELECT url FROM forgotten)""")
def _export(t):
    return lib.export_privacy(referred(t), t.forgotten(), True).select("url", "referrer", "search")


@query("export_privacy_bare", """
SELECT url, NULL::VARCHAR AS referrer, NULL::VARCHAR AS search FROM referred
WHERE url NOT IN (SELECT url FROM forgotten)""")
def _export_bare(t):
    return lib.export_privacy(referred(t), t.forgotten(), False).select("url", "referrer", "search")


@query("fold_and_normalize_tag", """
WITH raw AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '  ' || upper(source) || '   x ' WHEN 1 THEN text[1:30]
  WHEN 2 THEN ' ' WHEN 3 THEN repeat(source, 11) ELSE source || chr(7) END AS raw FROM documents),
n AS (SELECT doc_id, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS n FROM raw),
p AS (SELECT *, CASE WHEN n = '' THEN 'it is empty' WHEN length(n) > 40 THEN 'it is longer than 40 characters'
  WHEN regexp_matches(n, '[\\x00-\\x1f\\x7f]') THEN 'it contains a control character' END AS problem FROM n)
SELECT doc_id, CASE WHEN problem IS NULL THEN n END AS name, lower(CASE WHEN problem IS NULL THEN n END) AS fold,
  problem FROM p""")
def _normalize(t):
    k = F.col("doc_id") % 5
    raw = (F.when(k == 0, F.concat(F.lit("  "), F.upper("source"), F.lit("   x ")))
           .when(k == 1, F.substring("text", 1, 30)).when(k == 2, " ")
           .when(k == 3, F.repeat("source", 11)).otherwise(F.concat(F.col("source"), F.lit("\x07"))))
    d = t.raw("documents").select("doc_id", text.normalize_tag(raw).alias("n"))
    return d.select("doc_id", "n.name", text.fold_tag("n.name").alias("fold"), "n.problem")


@query("sort_name", """
SELECT url, regexp_replace(CASE WHEN trim(title) = '' THEN url ELSE title END, '^[^\\p{L}\\p{N}]+', '') AS name
FROM (SELECT url, CASE WHEN page_id % 5 = 0 THEN '' ELSE '** ' || title END AS title FROM site_pages)""")
def _sort_name(t):
    title = F.when(F.col("page_id") % 5 == 0, "").otherwise(F.concat(F.lit("** "), "title"))
    return t.site_pages().select("url", text.sort_name(title, "url").alias("name"))


@query("decode_session_values", """
SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'normal' WHEN 1 THEN 'popup' WHEN 2 THEN 'app' WHEN 3 THEN 'devtools'
  WHEN 4 THEN 'app_popup' ELSE 'unknown' END AS kind,
  coalesce(['blue','red','yellow','green','pink','purple','cyan','orange'][event_id % 11], 'grey') AS colour,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE epoch_us(ts) END AS happened FROM events""")
def _decode(t):
    m = F.when(F.col("event_id") % 13 == 0, 0).otherwise(F.unix_micros("ts") + text.EPOCH_1601_MICROS)
    return t.raw("events").select(
        "event_id", text.decode_kind(F.col("event_id") % 7).alias("kind"),
        text.decode_colour(F.col("event_id") % 11).alias("colour"), micros(text.chrome_time(m)).alias("happened"))


@query("tag_order", """
SELECT name, row_number() OVER (ORDER BY lower(name), name) AS place FROM vocabulary""")
def _tag_order(t):
    v = t.vocabulary().select("name")
    return ordered.row_number(v, [], text.tag_order("name"), [Coarse(F.ascii(F.lower("name")))], "place")


@query("snippet", """
WITH q AS (SELECT doc_id, text, source, list_filter(string_split_regex(lower('than Que ' || lang || ' la'), '\\s+'),
  lambda w: w <> '') AS words FROM documents),
f AS (SELECT *, list_filter(list_transform(words, lambda w: instr(lower(text), w)), lambda p: p > 0)[1] AS hit FROM q),
s AS (SELECT *, greatest(hit - 60, 1) AS start FROM f)
SELECT doc_id, CASE WHEN hit IS NOT NULL THEN CASE WHEN start > 1 THEN '…' ELSE '' END
  || trim(regexp_replace(text[start:start + 199], '\\s+', ' ', 'g'))
  || CASE WHEN length(text) > start - 1 + 200 THEN '…' ELSE '' END END AS quote FROM s""")
def _snippet(t):
    words = text.words_of(F.concat(F.lit("than Que "), F.col("lang"), F.lit(" la")))
    return t.raw("documents").select("doc_id", text.snippet("text", words).alias("quote"))
