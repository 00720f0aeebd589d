"""Sources, sinks and streams over logs and snapshots made from the given tables."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from pagelib.operators import library as lib
from pagelib.operators import logs, tags, visits
from pagelib.plans.log_queries import SQL_VIEWS as _VIEWS  # noqa: F401  the fold views are defined there
from pagelib.plans.registry import query
from pagelib.plans.tables import SQL_VIEWS, Tables
from pagelib.session import materialise, scratch
from pagelib.sources import exports
from pagelib.sources import logs as log_source
from pagelib.sources import snapshots as snapshot_source
from pagelib.sources import visits as visit_source
from pagelib.streaming import logs as streams
from pagelib.streaming import sessions

LOG = "url string, seq long, attempted_at timestamp, status string, tier string, reason string, chars long, content_sha256 string"


# --- log files: the content log written as lines, some of them broken

def log_file(t: Tables) -> str:
    path = scratch(t.spark, "log")
    log = t.content_log()
    line = F.to_json(F.struct(F.when(F.col("seq") % 17 == 0, 2).otherwise(1).alias("schema_version"), *log.columns))
    text = (F.when(F.col("seq") % 19 == 0, F.lit("not a record")).when(F.col("seq") % 23 == 0, F.lit(""))
            .when(F.col("seq") % 29 == 0, F.lit('{"schema_version": 1}')).otherwise(line))
    log.select(text.alias("value")).write.text(path)
    return path


_GOOD = "seq % 17 <> 0 AND seq % 19 <> 0 AND seq % 23 <> 0 AND seq % 29 <> 0"


@query("read_log", f"SELECT url, seq, status, tier, reason, chars FROM content_log WHERE {_GOOD}")
def _read_log(t):
    rows, _ = log_source.read_log(t.spark, log_file(t), LOG)
    return rows.select("url", "seq", "status", "tier", "reason", "chars")


@query("read_log_unreadable", """
SELECT count(*) AS unreadable FROM content_log WHERE seq % 19 = 0 OR (seq % 23 <> 0 AND (seq % 29 = 0 OR seq % 17 = 0))""")
def _unreadable(t):
    return log_source.read_log(t.spark, log_file(t), LOG)[1]


@query("append_log", "SELECT url, seq, status, reason FROM content_log")
def _append(t):
    path, log = scratch(t.spark, "append"), t.content_log()
    log_source.append_log(log.where("seq % 2 = 0"), path)
    log_source.append_log(log.where("seq % 2 = 1"), path)
    return log_source.read_log(t.spark, path, LOG)[0].select("url", "seq", "status", "reason")


# --- snapshot documents: forty sightings each

def snapshot_folder(t: Tables) -> str:
    path = scratch(t.spark, "snapshots")
    tab = F.struct("tab_id", F.when((F.col("doc") % 9 == 4) & (F.col("tab_id") % 40 == 1), 0).otherwise(F.col("window")).cast("int").alias("window"),
                   F.col("position").cast("int").alias("position"), "url", "title", "pinned", "active", "group")
    s = t.sightings().withColumn("doc", F.floor(F.col("tab_id") / 40))
    docs = s.groupBy("doc").agg(F.min("captured_at").alias("captured_at"), F.collect_list(tab).alias("tabs"))
    line = F.to_json(F.struct(F.when(F.col("doc") % 7 == 3, 2).otherwise(1).alias("schema_version"), F.lit("other").alias("id"), "captured_at",
                              F.array().cast("array<struct<id: int>>").alias("windows"), F.array().cast("array<struct<id: string>>").alias("groups"), "tabs"))
    text = F.when(F.col("doc") % 11 == 5, F.lit("{")).otherwise(line)
    docs.select(F.concat(F.lit("name=d"), F.col("doc").cast("string")).alias("name"), text.alias("value")).foreachPartition(_writer(path))
    return path


def _writer(path: str):
    """Writes (name, value) rows as one small document each, in a folder of its name; a repeated task writes the same again.

    Spark's own writer makes a temporary folder, a checksum file and several moves for each of them.
    """
    place = path if ":" in path else os.path.abspath(path)

    def write(rows) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(place)
        for row in rows:
            store.create_dir(f"{root}/{row['name']}")
            with store.open_output_stream(f"{root}/{row['name']}/document") as out:
                out.write(row["value"].encode() + b"\n")

    return write


_USABLE = "doc % 7 <> 3 AND doc % 11 <> 5 AND NOT (doc % 9 = 4)"


@query("read_snapshots", f"""
SELECT 'name=d' || doc AS snapshot_id, tab_id, url FROM (SELECT *, tab_id // 40 AS doc FROM sightings) WHERE {_USABLE}""")
def _snapshots(t):
    return snapshot_source.read_snapshots(t.spark, snapshot_folder(t), "*")["tabs"].select("snapshot_id", "tab_id", "url")


@query("read_snapshots_unreadable", f"""
SELECT DISTINCT 'name=d' || doc AS snapshot_id FROM (SELECT *, tab_id // 40 AS doc FROM sightings) WHERE NOT ({_USABLE})""")
def _bad_snapshots(t):
    return snapshot_source.read_snapshots(t.spark, snapshot_folder(t), "*")["unreadable"].select("snapshot_id")


# --- visit tables in the browser's own columns

def visit_folder(t: Tables) -> str:
    path = scratch(t.spark, "visits")
    chrome = lambda c: F.coalesce(F.unix_micros(c) + 11644473600000000, F.lit(0))
    t.visit_urls().withColumn("last_visit_time", chrome("last_visit_time")).write.parquet(f"{path}/urls")
    v = t.visits()
    v.select("id", F.col("url_id").alias("url"), chrome("visit_time").alias("visit_time"), F.coalesce("from_visit", F.lit(0)).alias("from_visit"),
             F.coalesce("opener_visit", F.lit(0)).alias("opener_visit")).write.parquet(f"{path}/visits")
    v.select(F.col("id").alias("visit_id"), F.col("foreground_micros").alias("total_foreground_duration")).write.parquet(f"{path}/context_annotations")
    return path


@query("read_visits", """
SELECT u.url, visit_count AS visits, epoch_us(last_visit_time) AS last_visit, epoch_us(first_visit) AS first_visit, foreground_seconds,
  NULL::VARCHAR AS term, i.referrer FROM visit_urls u JOIN (SELECT url_id, min(visit_time) AS first_visit,
  floor(sum(foreground_micros) FILTER (foreground_micros > 0) / 1000000)::BIGINT AS foreground_seconds FROM visits GROUP BY url_id) r ON r.url_id = u.id
LEFT JOIN (SELECT c.url_id, arg_max(x.url, (c.visit_time, l.parent = c.from_visit, l.parent)) AS referrer FROM visits c
  JOIN links_back l ON l.child = c.id AND l.parent <> 0 JOIN visits p ON p.id = l.parent AND p.url_id <> c.url_id JOIN visit_urls x ON x.id = p.url_id GROUP BY c.url_id) i
  ON i.url_id = u.id WHERE last_visit_time IS NOT NULL""")
def _visits(t):
    tables, _ = visit_source.read_visits(visit_source.parquet_loader(t.spark, visit_folder(t)))
    s = visits.visit_signals(tables["pages"], tables["visits"], tables["terms"])
    return s.select("url", "visits", F.unix_micros("last_visit").alias("last_visit"), F.unix_micros("first_visit").alias("first_visit"),
                    "foreground_seconds", "term", "referrer")


# --- what the library writes, read back

@query("write_library", """
SELECT snapshot_id, count(*) AS tabs, count(DISTINCT url) AS pages, sum(position)::BIGINT AS places, count("group") AS grouped FROM placed
WHERE url NOT IN (SELECT url FROM forgotten) GROUP BY snapshot_id""")
def _export(t):
    path = scratch(t.spark, "library")
    s, gone = t.sightings(), t.forgotten()
    exports.write_library(s, lib.library_pages(s, gone), lib.library_stats(s, gone), t.vocabulary(), path)
    back = t.spark.read.schema("snapshot_id string, url string, window long, position long, tab_id long, pinned int, `group` string").json(f"{path}/tabs")
    return back.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("tabs"), F.countDistinct("url").alias("pages"), F.sum("position").alias("places"),
                                           F.count("group").alias("grouped"))


@query("write_worklist", """
SELECT p.url, trim(regexp_replace(p.title, '\\s+', ' ', 'g')) AS title, CASE WHEN page_id % 3 = 0 THEN 'Fetched ' || page_id END AS page_title FROM kept_pages p JOIN pages USING (url)
WHERE p.url NOT IN (SELECT url FROM shown WHERE tag = 'Toxic') AND p.url NOT IN (SELECT url FROM suggested WHERE seq % 4 = 1 AND lower(source) = 'signup')""")
def _worklist(t):
    path = scratch(t.spark, "worklist")
    due = tags.prompt_due(lib.library_pages(t.sightings(), t.forgotten()), t.page_tags().where("name = 'Toxic'"), t.vocabulary(),
                          t.suggested().where("seq % 4 = 1 AND lower(source) = 'signup'"))
    p = F.col("page_id")
    meta = t.site_pages().select("url", F.lit("ok").alias("status"), F.when(p % 3 == 0, F.concat(F.lit("Fetched "), p.cast("string")))
                                 .otherwise(F.col("title")).alias("title"), F.lit(None).cast("string").alias("description"))
    exports.write_worklist(exports.worklist(due, meta), path)
    return t.spark.read.schema("url string, title string, page_title string").json(path)


@query("write_suggestions", """
WITH p AS (SELECT page_id, url, unnest(['en', 'fr', 'quality']) AS tag, unnest([page_id % 10 / 10, page_id % 7 / 7, page_id % 3 / 3]) AS score FROM pages)
SELECT url, string_agg(tag, ',' ORDER BY tag) AS tags FROM p WHERE score >= 0.5 AND NOT EXISTS (SELECT 1 FROM shown s WHERE s.url = p.url AND s.tag = p.tag) GROUP BY url""")
def _suggestions(t):
    path, i = scratch(t.spark, "suggestions"), F.col("page_id")
    each = F.array(*[F.struct(F.lit(n).alias("tag"), (i % k / k).alias("score")) for n, k in (("en", 10), ("fr", 7), ("quality", 3))])
    p = t.site_pages().select("url", "title", F.explode(each).alias("x")).select("url", "title", "x.*", F.lit(0.5).alias("threshold"),
                                                                              F.lit("full fit").alias("prediction"))
    lines, scores = exports.suggestion_lines(p, tags.shown_tags(t.page_tags(), t.vocabulary()))
    exports.write_suggestions(lines, scores, path)
    return t.spark.read.schema("url string, tags array<string>").json(f"{path}/suggestions").select("url", F.array_join("tags", ",").alias("tags"))


# --- streams: the log is a file stream in three batches

PART_FILES = 4


def streamed(t: Tables, df) -> object:
    """A table as a stream of three parts in the order of seq or time, each of several files that come as one batch."""
    path = scratch(t.spark, "stream")
    for part in range(3):
        df.where(F.col("part") == part).drop("part").repartition(PART_FILES).write.mode("append").parquet(path)
    schema = df.drop("part").schema
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", PART_FILES).parquet(path)


def thirds(t: Tables, column: str = "seq"):
    third = F.ceil((F.col(column) + 1) / (t.count_of("events") / 3)) - 1
    return F.least(third, F.lit(2))


def _paths(t: Tables, name: str):
    return scratch(t.spark, name), scratch(t.spark, name + "-checkpoint")


@query("latest_stream", "SELECT url, seq, status, chars FROM latest_content")
def _latest(t):
    log = t.content_log().withColumn("part", thirds(t))
    return streams.latest_stream(streamed(t, log), *_paths(t, "latest")).select("url", "seq", "status", "chars")


@query("attempt_stream", """
SELECT url, seq, attempt, CASE WHEN status = 'error' AND attempt >= 3 THEN 'unavailable' ELSE status END AS settled_status FROM settled""")
def _attempts(t):
    log = t.content_log().select("url", "seq", "status", "reason").withColumn("part", thirds(t))
    return streams.attempt_stream(streamed(t, log), *_paths(t, "attempts")).select("url", "seq", "attempt", "settled_status")


@query("bookmark_stream", "SELECT url, kind, value, place FROM marks")
def _bookmarks(t):
    log = t.bookmark_log().withColumn("part", thirds(t))
    items = streams.bookmark_stream(streamed(t, log), *_paths(t, "bookmarks"))
    return streams.bookmark_view(items).select("url", "kind", "value", "place")


@query("change_stream", """
SELECT id, digest FROM (SELECT *, lag(digest) OVER (PARTITION BY browser, profile ORDER BY captured_at, id) AS previous FROM captures)
WHERE previous IS NULL OR previous <> digest""")
def _changes(t):
    # Batches follow capture time, as captures are made.
    day = F.dayofmonth("captured_at")
    captures = t.captures().withColumn("part", F.when(day <= 10, 0).when(day <= 20, 1).otherwise(2))
    return streams.change_stream(streamed(t, captures), *_paths(t, "changes")).select("id", "digest")


# --- browser sessions: a command per event

_KIND = ["tab_window", "navigation", "selected_navigation", "navigation", "tab_index", "window_type", "prune_back", "navigation",
         "selected_tab", "prune_front", "pinned", "navigation", "tab_group", "prune", "group_meta", "last_active", "navigation",
         "tab_closed", "marker", "navigation", "window_closed", "tab_window", "window_type"]


def commands(t: Tables):
    e, u = F.col("event_id"), F.col("user_id")
    kind = F.get(F.array(*map(F.lit, _KIND)), (e % 23).cast("int"))
    on_tab = kind.isin("tab_window", "tab_index", "navigation", "selected_navigation", "prune_back", "prune_front", "prune", "pinned",
                       "tab_closed", "last_active", "tab_group")
    on_window = kind.isin("tab_window", "selected_tab", "window_type", "window_closed")
    return t.raw("events").select(
        u.alias("session"), e.alias("seq"), kind.alias("kind"), F.when(on_tab, F.floor(e / 3) % 4 + 1).alias("tab"),
        F.when(on_window, F.floor(e / 5) % 3 + 1).alias("window"), (F.floor(e / 7) % 5).cast("int").alias("index"),
        (F.floor(e / 11) % 3).cast("int").alias("count"), F.concat(F.lit("https://s.example/"), e.cast("string")).alias("url"),
        F.concat(F.lit("Page "), e.cast("string")).alias("title"), (F.floor(e / 2) % 2 == 0).alias("flag"),
        F.concat(F.lit("g"), (F.floor(e / 13) % 3).cast("string")).alias("token"), F.col("ts").alias("at"))


@query("session_fold_tabs")
def _session_tabs(t):
    return sessions.session_fold(materialise(commands(t), "commands"))["tabs"]


@query("session_fold_windows", """
WITH k AS (SELECT user_id AS session, event_id AS seq, (event_id // 5) % 3 + 1 AS w, event_id % 23 AS kind, (event_id // 7) % 5 AS index FROM events
  WHERE event_id % 23 IN (5, 20, 22)),
o AS (SELECT session, w, arg_max(kind, seq) AS kind, arg_max(index, seq) AS index FROM k GROUP BY 1, 2)
SELECT session, w AS "window", row_number() OVER (PARTITION BY session ORDER BY w) AS number,
  ['normal', 'popup', 'app', 'devtools', 'app_popup'][index + 1] AS kind FROM o WHERE kind <> 20""")
def _session_windows(t):
    return sessions.session_fold(materialise(commands(t), "commands"))["windows"].select("session", "window", "number", "kind")


@query("session_fold_stats")
def _session_stats(t):
    return sessions.session_fold(materialise(commands(t), "commands"))["stats"]


@query("tab_stream")
def _tab_stream(t):
    c = commands(t).withColumn("part", thirds(t))
    return sessions.tab_stream(streamed(t, c), *_paths(t, "tabs"))
