"""The given test tables as the library's tables.

`Tables` builds each one as a DataFrame; `SQL_VIEWS` states the same definition
for the SQL twin. Neither uses a window, so the adapters stay map-side but for
the one join from events to pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Address shapes the page table lacks, made from every page: text over
# (url, base, page_id) that both engines read.
URL_VARIANTS = [
    "url",
    "'http://localhost:3000/p/' || page_id",
    "'http://dev.localhost/' || page_id",
    "'http://127.0.0.' || (page_id % 250) || ':8080/'",
    "'http://[::1]:3000/x' || page_id",
    "replace(base, '://', '://user:pw@')",
    "base || '?utm_medium=x&gclid=1&id=' || page_id || '&B=2'",
    "base || '?token=abc' || page_id",
    "base || '/search?q=' || page_id",
    "'http://192.168.' || (page_id % 250) || '.7/admin'",
    "'http://172.' || (page_id % 40) || '.0.1/'",
    "'http://203.0.' || (110 + page_id % 6) || '.9/x/'",
    "'http://8.8.8.' || (page_id % 250) || '/dns'",
    "'https://login.example.com/' || page_id",
    "base || '/Sign-In.php'",
    "base || '/accounts/' || page_id",
    "'https://github.com/Owner' || (page_id % 7) || '/Repo.git'",
    "'https://github.com/Owner' || (page_id % 7) || '/Repo/issues/' || page_id",
    "'https://www.github.com/topics/Repo' || page_id",
    "'https://github.com/o/r/pull/' || (page_id % 5) || '/files'",
    "'https://www.youtube.com/watch?t=1&v=' || lpad(cast(page_id as varchar(20)), 11, 'a')",
    "'https://youtu.be/' || lpad(cast(page_id as varchar(20)), 11, 'a')",
    "'https://m.youtube.com/@channel' || page_id",
    "'https://x.com/someone/status/' || page_id || '/photo/1'",
    "'https://mobile.twitter.com/someone' || page_id",
    "'file:///tmp/' || page_id || '.html'",
    "'about:blank?' || page_id",
    "'not a url ' || page_id",
    "base || '/#/route/' || page_id",
    "base || '#!x' || page_id",
    "'https://www.google.com/search?q=' || page_id",
    "'https://duckduckgo.com/?q=' || page_id",
    "'https://docs.google.com/document/d/' || page_id",
    "'http://intranet/' || page_id",
    "'https://printer.local/' || page_id",
    "'https://Box.Home.Arpa/' || page_id",
    "base || '///'",
    "base || '?v=eyJ' || repeat('a', cast(page_id % 60 as int))",
    "base || '?Utm%5FSource=z&b=2'",
    "'https://WWW.Example.COM:8443/A%20b+c/' || page_id || '/'",
    "'http://[2606:4700::11]/' || page_id",
    "'http://[fe80::1]/' || page_id",
    "'http://[::ffff:10.0.0.1]/' || page_id",
    "'chrome://newtab/' || page_id",
]

_BASE = r"^([^?#]*)"
_TITLE = r"<title>(.*?)</title>"


class Tables:
    """The library's tables over one folder of given parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return df.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else df

    def count_of(self, name: str) -> Column:
        """Row count of a given table as a scalar subquery."""
        return self.raw(name).agg(F.count(F.lit(1))).scalar()

    def site_pages(self) -> DataFrame:
        p = self.raw("pages")
        return p.select("page_id", "url", F.regexp_extract("html", _TITLE, 1).alias("title"))

    def url_variants(self) -> DataFrame:
        p = self.raw("pages").select("page_id", "url",
                                     F.regexp_extract("url", _BASE, 1).alias("base"))
        texts = F.array(*[F.expr(v) for v in URL_VARIANTS])
        return p.select("page_id", F.posexplode(texts).alias("variant", "url"))

    def page_events(self) -> DataFrame:
        """Events with the page each one is about."""
        e = self.raw("events")
        user, event = F.col("user_id"), F.col("event_id")
        page = (user * 37 + (event % 11) * (event % 7) * 3 + (event % 5) * (event % 5))
        return e.withColumn("page_id", page % self.count_of("pages"))

    def sightings(self) -> DataFrame:
        """Tabs seen in daily snapshots."""
        e = self.page_events()
        event = F.col("event_id")
        clicked = F.col("event_type").isin("click", "view")
        return e.join(self.site_pages(), "page_id").select(
            F.date_format("ts", "yyyy-MM-dd").alias("snapshot_id"),
            F.date_trunc("day", "ts").alias("captured_at"),
            F.concat(F.lit("b"), (F.col("user_id") % 2).cast("string")).alias("browser"),
            (F.col("user_id") % 5 + 1).alias("window"),
            F.when(event % 23 == 0, -1).otherwise(
                F.hour("ts") * 60 + F.minute("ts")).cast("long").alias("position"),
            event.alias("tab_id"),
            F.col("url"),
            F.when(event % 7 == 0, "").otherwise(F.col("title")).alias("title"),
            (F.col("event_type") == "purchase").alias("pinned"),
            F.when(clicked, F.col("event_type")).alias("group"),
            (event % 5 == 0).alias("active"))

    def local_sightings(self) -> DataFrame:
        """`sightings` with some tabs on this machine."""
        s = self.sightings()
        local = F.concat(F.lit("http://localhost:"), F.col("tab_id").cast("string"))
        return s.withColumn("url", F.when(F.col("tab_id") % 29 == 0, local).otherwise(F.col("url")))

    def captures(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("id"), F.col("ts").alias("captured_at"),
            F.concat(F.lit("b"), (F.col("user_id") % 2).cast("string")).alias("browser"),
            F.lit(None).cast("string").alias("profile"), F.col("event_type").alias("digest"))

    def snapshot_stats(self) -> DataFrame:
        n = lambda kind, k: (F.count(F.when(F.col("event_type") == kind, 1)) % k)
        return (self.raw("events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("snapshot_id"))
                .agg(n("error", 3).alias("dropped_tabs"), n("view", 2).alias("unknown_commands"),
                     n("click", 5).alias("truncated_bytes"),
                     n("signup", 2).alias("malformed_commands"),
                     n("purchase", 3).alias("navigation_fallbacks"),
                     n("click", 2).alias("groups_without_metadata"),
                     (F.max(F.when(F.dayofmonth("ts") % 9 == 0, 2).otherwise(1))).cast("long")
                     .alias("marker_count")))

    def forgotten(self) -> DataFrame:
        return self.raw("pages").where("page_id % 17 = 0").select("url")

    def added(self) -> DataFrame:
        """Add requests: some pages twice, the later line with another title."""
        e = self.page_events().where(F.col("event_type") == "signup")
        return e.join(self.site_pages(), "page_id").select(
            "url", F.col("event_id").alias("seq"), F.col("ts").alias("added_at"),
            F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(
                F.concat_ws(" ", F.col("title"), F.col("event_id").cast("string"))).alias("title"))

    def content_log(self) -> DataFrame:
        e = self.page_events()
        kind, event = F.col("event_type"), F.col("event_id")
        status = (F.when(kind.isin("view", "purchase"), "ok").when(kind == "click", "thin")
                  .when(kind == "signup", "behind_login").otherwise("error"))
        reason = (F.when((kind == "click") & (event % 4 == 0), "not rendered: HTTP 403")
                  .when(kind == "error", F.concat(F.lit("HTTP "), (500 + event % 5).cast("string"))))
        tier = (F.when(event % 5 == 0, "x").when(event % 7 == 0, "signed_in").otherwise("web"))
        return e.join(self.raw("pages").select("page_id", "url"), "page_id").select(
            "url", event.alias("seq"), F.col("ts").alias("attempted_at"), status.alias("status"),
            tier.alias("tier"), reason.alias("reason"),
            F.floor(F.col("value") * 10).cast("long").alias("chars"),
            F.sha2(F.concat_ws(":", F.col("page_id").cast("string"),
                               (event % 3).cast("string")), 256).alias("content_sha256"))

    def visits(self) -> DataFrame:
        """Visits: id, page, time, the visit it came from, an opener, dwell."""
        event = F.col("event_id")
        return self.page_events().select(
            event.alias("id"), F.col("page_id").alias("url_id"), F.col("ts").alias("visit_time"),
            F.when(event % 6 != 0, event - 1 - event % 7).alias("from_visit"),
            F.when(event % 2 == 1, event - 2 - event % 11).alias("opener_visit"),
            F.when(event % 31 == 0, F.concat(F.lit("https://outside.example/"),
                                            (event % 5).cast("string")))
            .alias("external_referrer_url"),
            F.when(F.col("event_type") == "view", F.floor(F.col("value") * 1000000))
            .otherwise(-1000000).cast("long").alias("foreground_micros"))

    def visit_urls(self) -> DataFrame:
        """The visited addresses with their counters and last visit."""
        e = self.page_events()
        agg = e.groupBy("page_id").agg(F.count(F.lit(1)).alias("visit_count"),
                                       F.count(F.when(F.col("event_type") == "purchase", 1))
                                       .alias("typed_count"), F.max("ts").alias("last_visit_time"))
        return agg.join(self.raw("pages").select("page_id", "url"), "page_id").select(
            F.col("page_id").alias("id"), "url", "visit_count", "typed_count",
            F.when(F.col("page_id") % 53 != 0, F.col("last_visit_time")).alias("last_visit_time"))

    def search_terms(self) -> DataFrame:
        return self.raw("pages").where("page_id % 40 = 7").select(
            F.col("page_id").alias("url_id"),
            F.concat(F.lit("term "), F.col("page_id").cast("string")).alias("term"))

    def doc_tags(self) -> DataFrame:
        """Tags of documents: language, source, and the labels that are set."""
        d, lab = self.raw("documents").select("doc_id", "lang", "source"), self.raw("labels")
        tags = F.array_compact(F.array(
            F.col("lang"), F.col("source"), F.when(F.col("quality") == 1, "quality"),
            F.when(F.col("toxic") == 1, "Toxic")))
        return d.join(lab, "doc_id", "left").select("doc_id", F.explode(tags).alias("tag"))

    def page_tags(self) -> DataFrame:
        n = self.count_of("pages")
        on = self.doc_tags().withColumn("page_id", F.col("doc_id") % n)
        side = F.when(F.col("doc_id") % 11 == 0, "remove").otherwise("add")
        return (on.join(self.raw("pages").select("page_id", "url"), "page_id")
                .groupBy("url", F.col("tag").alias("name"))
                .agg(F.max_by(side, F.col("doc_id")).alias("side")))

    def vocabulary(self) -> DataFrame:
        names = self.doc_tags().groupBy(F.col("tag").alias("name")).agg(
            F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        day = lambda c: F.timestamp_seconds(F.lit(1704067200) + F.col(c) * 60)
        return names.select(
            "name", day("first_doc").alias("created_at"),
            F.when(F.col("name").rlike("^src1[13579]$"), day("last_doc")).alias("retired_at"),
            F.when(F.length("name") % 2 == 0, F.concat(F.lit("about "), F.col("name")))
            .alias("definition"),
            F.when(F.col("last_doc") % 3 != 0, day("last_doc")).alias("used_at"))

    def suggested(self) -> DataFrame:
        e = self.page_events()
        doc = self.raw("documents").select(F.col("doc_id").alias("d"), "lang")
        e = e.withColumn("d", F.col("event_id") % self.count_of("documents"))
        t = F.concat(F.lit("Src"), (F.col("user_id") % 12).cast("string"))
        return (e.join(doc, "d").join(self.raw("pages").select("page_id", "url"), "page_id")
                .select("url", F.col("event_id").alias("seq"), F.array(t, F.col("lang")).alias("tags"),
                        F.initcap("event_type").alias("source"), F.col("ts").alias("imported_at"),
                        F.concat(F.lit("v"), (F.col("event_id") % 2).cast("string"))
                        .alias("vocabulary_version")))

    def bookmark_log(self) -> DataFrame:
        """Clicks on saved threads: the posts the click named and what they link to."""
        n = self.count_of("pages")
        e = self.page_events().where(F.col("event_type").isin("click", "purchase"))
        p = self.raw("pages").select("page_id", "url")
        to = p.select(F.col("page_id").alias("to_id"), F.col("url").alias("link"))
        event = F.col("event_id")
        return (e.withColumn("to_id", (event * 7) % n).join(p, "page_id").join(to, "to_id").select(
            "url", event.alias("seq"), F.date_trunc("hour", "ts").alias("clicked_at"),
            F.when(F.col("event_type") == "click", (event % 40).cast("string")).alias("post"),
            F.array((event % 40).cast("string"), (event % 13).cast("string")).alias("posts"),
            F.array(F.col("link")).alias("links")))

    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")

    def search_docs(self) -> DataFrame:
        """Documents as pages, without their texts: titles are cut before the join."""
        d = self.raw("documents").select(
            F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), "lang", "source",
            (F.col("doc_id") % self.count_of("pages")).alias("page_id"))
        return d.join(self.raw("pages").select("page_id", "url"), "page_id").select("id", "title", "url", "lang", "source")

    def texts(self) -> DataFrame:
        return self.raw("documents").select(F.col("doc_id").alias("id"), "text")


_PAGE_OF = ("(user_id*37 + (event_id%11)*(event_id%7)*3 + (event_id%5)*(event_id%5)) "
            "% (SELECT count(*) FROM pages)")

SQL_VIEWS = {
    "site_pages": f"SELECT page_id, url, regexp_extract(html, '{_TITLE}', 1) AS title FROM pages",
    "url_variants": (
        "SELECT page_id, unnest(range(len(texts)))::INTEGER AS variant, unnest(texts) AS url FROM ("
        f"SELECT page_id, [{', '.join(URL_VARIANTS)}] AS texts FROM ("
        f"SELECT page_id, url, regexp_extract(url, '{_BASE}', 1) AS base FROM pages))"),
    "page_events": f"SELECT *, {_PAGE_OF} AS page_id FROM events",
    "sightings": """
SELECT strftime(ts, '%Y-%m-%d') AS snapshot_id, date_trunc('day', ts)::TIMESTAMP AS captured_at,
  'b' || (user_id % 2) AS browser, user_id % 5 + 1 AS "window",
  CASE WHEN event_id % 23 = 0 THEN -1 ELSE hour(ts)*60 + minute(ts) END::BIGINT AS position,
  event_id AS tab_id, url, CASE WHEN event_id % 7 = 0 THEN '' ELSE title END AS title,
  event_type = 'purchase' AS pinned,
  CASE WHEN event_type IN ('click', 'view') THEN event_type END AS "group",
  event_id % 5 = 0 AS active
FROM page_events JOIN site_pages USING (page_id)""",
    "local_sightings": """
SELECT * REPLACE (CASE WHEN tab_id % 29 = 0 THEN 'http://localhost:' || tab_id ELSE url END AS url)
FROM sightings""",
    "captures": """
SELECT event_id AS id, ts AS captured_at, 'b' || (user_id % 2) AS browser,
  NULL::VARCHAR AS profile, event_type AS digest FROM events""",
    "snapshot_stats": """
SELECT strftime(ts, '%Y-%m-%d') AS snapshot_id,
  count(*) FILTER (event_type = 'error') % 3 AS dropped_tabs,
  count(*) FILTER (event_type = 'view') % 2 AS unknown_commands,
  count(*) FILTER (event_type = 'click') % 5 AS truncated_bytes,
  count(*) FILTER (event_type = 'signup') % 2 AS malformed_commands,
  count(*) FILTER (event_type = 'purchase') % 3 AS navigation_fallbacks,
  count(*) FILTER (event_type = 'click') % 2 AS groups_without_metadata,
  max(CASE WHEN day(ts) % 9 = 0 THEN 2 ELSE 1 END)::BIGINT AS marker_count
FROM events GROUP BY 1""",
    "forgotten": "SELECT url FROM pages WHERE page_id % 17 = 0",
    "added": """
SELECT url, event_id AS seq, ts AS added_at,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE title || ' ' || event_id END AS title
FROM page_events JOIN site_pages USING (page_id) WHERE event_type = 'signup'""",
    "content_log": """
SELECT url, event_id AS seq, ts AS attempted_at,
  CASE WHEN event_type IN ('view', 'purchase') THEN 'ok' WHEN event_type = 'click' THEN 'thin'
       WHEN event_type = 'signup' THEN 'behind_login' ELSE 'error' END AS status,
  CASE WHEN event_id % 5 = 0 THEN 'x' WHEN event_id % 7 = 0 THEN 'signed_in' ELSE 'web' END AS tier,
  CASE WHEN event_type = 'click' AND event_id % 4 = 0 THEN 'not rendered: HTTP 403'
       WHEN event_type = 'error' THEN 'HTTP ' || (500 + event_id % 5) END AS reason,
  floor(value * 10)::BIGINT AS chars,
  sha256(page_id || ':' || (event_id % 3)) AS content_sha256
FROM page_events JOIN pages USING (page_id)""",
    "visits": """
SELECT event_id AS id, page_id AS url_id, ts AS visit_time,
  CASE WHEN event_id % 6 <> 0 THEN event_id - 1 - event_id % 7 END AS from_visit,
  CASE WHEN event_id % 2 = 1 THEN event_id - 2 - event_id % 11 END AS opener_visit,
  CASE WHEN event_id % 31 = 0 THEN 'https://outside.example/' || (event_id % 5) END
    AS external_referrer_url,
  CASE WHEN event_type = 'view' THEN floor(value * 1000000) ELSE -1000000 END::BIGINT
    AS foreground_micros
FROM page_events""",
    "visit_urls": """
SELECT page_id AS id, url, visit_count, typed_count,
  CASE WHEN page_id % 53 <> 0 THEN last_ts END AS last_visit_time
FROM (SELECT page_id, count(*) AS visit_count,
        count(*) FILTER (event_type = 'purchase') AS typed_count, max(ts) AS last_ts
      FROM page_events GROUP BY page_id) JOIN pages USING (page_id)""",
    "search_terms": "SELECT page_id AS url_id, 'term ' || page_id AS term FROM pages WHERE page_id % 40 = 7",
    "doc_tags": """
SELECT doc_id, unnest(list_filter([lang, source, CASE WHEN quality = 1 THEN 'quality' END,
  CASE WHEN toxic = 1 THEN 'Toxic' END], lambda x: x IS NOT NULL)) AS tag
FROM documents LEFT JOIN labels USING (doc_id)""",
    "page_tags": """
SELECT url, tag AS name, arg_max(CASE WHEN doc_id % 11 = 0 THEN 'remove' ELSE 'add' END, doc_id) AS side
FROM doc_tags JOIN pages ON page_id = doc_id % (SELECT count(*) FROM pages) GROUP BY url, tag""",
    "vocabulary": """
SELECT name, TIMESTAMP '2024-01-01' + to_minutes(first_doc) AS created_at,
  CASE WHEN regexp_matches(name, '^src1[13579]$') THEN TIMESTAMP '2024-01-01' + to_minutes(last_doc) END
    AS retired_at,
  CASE WHEN length(name) % 2 = 0 THEN 'about ' || name END AS definition,
  CASE WHEN last_doc % 3 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(last_doc) END AS used_at
FROM (SELECT tag AS name, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM doc_tags GROUP BY tag)""",
    "suggested": """
SELECT url, event_id AS seq, ['Src' || (user_id % 12), lang] AS tags,
  upper(event_type[1]) || event_type[2:] AS source, ts AS imported_at,
  'v' || (event_id % 2) AS vocabulary_version
FROM page_events JOIN pages USING (page_id)
JOIN documents ON doc_id = event_id % (SELECT count(*) FROM documents)""",
    "bookmark_log": """
SELECT p.url, event_id AS seq, date_trunc('hour', ts)::TIMESTAMP AS clicked_at,
  CASE WHEN event_type = 'click' THEN (event_id % 40)::VARCHAR END AS post,
  [(event_id % 40)::VARCHAR, (event_id % 13)::VARCHAR] AS posts, [l.url] AS links
FROM page_events e JOIN pages p USING (page_id)
JOIN pages l ON l.page_id = (event_id * 7) % (SELECT count(*) FROM pages)
WHERE event_type IN ('click', 'purchase')""",
    "vectors": "SELECT vec_id AS id, embedding AS vector, label FROM embeddings",
    "search_docs": """
SELECT doc_id AS id, string_split(text, chr(10))[1] AS title, text, url, lang, source
FROM documents JOIN pages ON page_id = doc_id % (SELECT count(*) FROM pages)""",
}
