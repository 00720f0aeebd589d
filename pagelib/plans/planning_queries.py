"""Fetch planning over the sightings, the content log and every address shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelib.functions import urls
from pagelib.operators import logs, planning
from pagelib.plans.registry import query
from pagelib.plans.tables import SQL_VIEWS, Tables
from pagelib.session import materialise
from pagelib.plans.url_queries import DOMAIN, KEY, LOGIN, PERSONAL, PRIVATE, ROUTE, SEARCH, TOKEN

# Every address shape as a tab of one of three snapshots, so all rules meet a plan.
SQL_VIEWS["shape_tabs"] = """
SELECT 'S' || (page_id % 3) AS snapshot_id, TIMESTAMP '2024-03-01' + to_days((page_id % 3)::INTEGER) AS captured_at,
  page_id % 4 + 1 AS "window", page_id AS position, page_id * 100 + variant AS tab_id, page_id, variant FROM url_variants"""


def shape_tabs(t: Tables):
    k = F.col("page_id") % 3
    return t.url_variants().select(
        F.concat(F.lit("S"), k.cast("string")).alias("snapshot_id"),
        F.timestamp_seconds(F.lit(1709251200) + k * 86400).alias("captured_at"),
        (F.col("page_id") % 4 + 1).alias("window"), F.col("page_id").alias("position"),
        (F.col("page_id") * 100 + F.col("variant")).alias("tab_id"), "url")


# The latest line of some addresses.
_STATUS = """CASE (page_id + variant) % 7 WHEN 0 THEN 'error' WHEN 1 THEN 'thin' WHEN 2 THEN 'ok' WHEN 3 THEN 'not_html'
  WHEN 4 THEN 'empty_shell' WHEN 5 THEN 'behind_login' ELSE NULL END"""
_REASON = """CASE (page_id + variant) % 7 WHEN 0 THEN 'timeout' WHEN 1 THEN CASE WHEN page_id % 2 = 0 THEN
  'short text; not rendered: HTTP 403' ELSE 'short text' END WHEN 3 THEN CASE WHEN page_id % 2 = 0 THEN
  'not HTML (application/pdf)' ELSE 'not HTML (video/mp4)' END WHEN 4 THEN CASE WHEN page_id % 2 = 0
  THEN 'drawn by scripts' ELSE 'app shell' END END"""
_TIER = "CASE WHEN page_id % 5 = 0 THEN 'signed_in' ELSE 'web' END"
SQL_VIEWS["shape_latest"] = f"""
SELECT page_id, variant, url, {_STATUS} AS status, {_REASON} AS reason, {_TIER} AS tier FROM url_variants
WHERE {_STATUS} IS NOT NULL"""


def shape_latest(t: Tables):
    v = t.url_variants()
    lines = v.select("url", F.expr(_STATUS).alias("status"), F.expr(_REASON).alias("reason"), F.expr(_TIER).alias("tier"))
    return lines.where("status is not null")


_RECORDED = """CASE WHEN status = 'error' THEN 'failed' WHEN status = 'not_html' AND tier = 'web'
  AND reason = 'not HTML (application/pdf)' THEN 'outdated' ELSE 'final' END"""
_ESCALATES = """(tier = 'web' AND (status = 'thin' OR (status = 'empty_shell'
  AND reason IN ('drawn by scripts', 'needs JavaScript'))))"""
_ELIGIBLE = """(tier = 'web' AND (status IN ('behind_login', 'paywalled', 'blocked') OR
  (status IN ('thin', 'empty_shell') AND reason LIKE '%not rendered: HTTP 403')))"""


@query("recorded_state", f"SELECT page_id * 100 + variant AS id, {_RECORDED} AS recorded FROM shape_latest")
def _recorded(t):
    v = t.url_variants().select((F.col("page_id") * 100 + F.col("variant")).alias("id"), F.expr(_STATUS).alias("status"),
                                F.expr(_REASON).alias("reason"), F.expr(_TIER).alias("tier")).where("status is not null")
    return planning.recorded_state(v).select("id", "recorded")


@query("escalates_and_eligible", f"""
SELECT page_id * 100 + variant AS id, coalesce({_ESCALATES}, false) AS escalates, coalesce({_ELIGIBLE}, false) AS eligible
FROM shape_latest""")
def _escalates(t):
    v = t.url_variants().select((F.col("page_id") * 100 + F.col("variant")).alias("id"), F.expr(_STATUS).alias("status"),
                                F.expr(_REASON).alias("reason"), F.expr(_TIER).alias("tier")).where("status is not null")
    return v.select("id", planning.escalates(v).alias("escalates"), planning.eligible_signed_in().alias("eligible"))


# One row per listed address; some variants of a page share one address with another page.
SQL_VIEWS["planned"] = f"""
SELECT * FROM (SELECT p.*, s.captured_at, s."window", s.position, l.status, l.reason AS why_status, l.tier,
  row_number() OVER (PARTITION BY p.url ORDER BY s.captured_at DESC, s."window", s.position) AS rn,
  {DOMAIN} AS domain, CASE WHEN NOT web THEN 'not a web page' WHEN p.url IN (SELECT url FROM forgotten) THEN 'forgotten'
    WHEN {PRIVATE} THEN 'private network' WHEN {SEARCH} THEN 'search results' WHEN {TOKEN} THEN 'token in URL' END AS skip,
  {LOGIN} AS login, {ROUTE} AS page_route, {KEY} AS page_key, {PERSONAL} AS personal,
  string_split(p.url, '#')[1] IN (SELECT string_split(url, '#')[1] FROM forgotten) AS covered
FROM url_parts p JOIN shape_tabs s USING (page_id, variant)
LEFT JOIN (SELECT url AS line_url, r.s AS status, r.r AS reason, r.t AS tier FROM (SELECT url,
  max_by(struct_pack(s := status, r := reason, t := tier), page_id) AS r FROM shape_latest GROUP BY url)) l ON l.line_url = p.url) WHERE rn = 1 AND domain IS NOT NULL"""


def distinct_latest(t: Tables):
    """One line per address: variants of two pages may be one address."""
    v = t.url_variants().select("page_id", "url", F.expr(_STATUS).alias("status"), F.expr(_REASON).alias("reason"),
                                F.expr(_TIER).alias("tier")).where("status is not null")
    return v.groupBy("url").agg(F.max_by(F.struct("status", "reason", "tier"), F.col("page_id")).alias("r")).select("url", "r.*")


_WHY = f"""CASE WHEN login THEN 'login' WHEN status IS NULL THEN 'new'
  WHEN {_RECORDED.replace('reason', 'why_status')} = 'failed' THEN 'retry' ELSE 'refetch' END"""
SQL_VIEWS["first_plan"] = f"""
SELECT *, CASE WHEN skip IS NOT NULL THEN 'skip' WHEN status IS NOT NULL
    AND {_RECORDED.replace('reason', 'why_status')} = 'final' THEN 'already' ELSE 'fetch' END AS outcome FROM planned"""


@query("fetch_plan", f"""
SELECT url, host, skip AS reason, outcome, CASE WHEN outcome = 'fetch' THEN {_WHY} END AS why FROM first_plan""")
def _plan(t):
    state = planning.recorded_state(distinct_latest(t))
    return planning.fetch_plan(shape_tabs(t), t.forgotten(), state).select("url", "host", "reason", "outcome", "why")


@query("fetch_plan_order", """
SELECT url, row_number() OVER (ORDER BY captured_at DESC, "window", position, url) AS place FROM first_plan
WHERE outcome = 'fetch'""")
def _plan_order(t):
    state = planning.recorded_state(distinct_latest(t))
    plan = materialise(planning.fetch_plan(shape_tabs(t), t.forgotten(), state).where("outcome = 'fetch'"), "plan")
    return planning.numbered(plan).select("url", "place")


@query("skip_counts", """
SELECT CASE WHEN outcome = 'already' THEN 'already fetched' ELSE skip END AS reason, count(*) AS pages FROM first_plan
WHERE outcome <> 'fetch' GROUP BY 1""")
def _skip_counts(t):
    state = planning.recorded_state(distinct_latest(t))
    return planning.skip_counts(planning.fetch_plan(shape_tabs(t), t.forgotten(), state))


_ESC = _ESCALATES.replace("reason", "why_status")


def _content_sql(browser: bool, video: bool, code: bool) -> str:
    return f"""
SELECT url, captured_at, "window", position, skip AS reason,
  CASE WHEN improvable AND outcome = 'already' AND login AND {browser}
      THEN CASE WHEN page_route IS NULL THEN 'not a document' ELSE 'unsent' END
    WHEN improvable AND outcome = 'already' THEN '{"render" if browser else "browser waiting"}'
    WHEN outcome <> 'fetch' THEN outcome WHEN covered THEN 'forgotten' WHEN page_route IS NULL THEN 'not a document'
    WHEN page_route = 'youtube' AND NOT {video} THEN 'waiting' WHEN {_WHY} = 'login' THEN 'unsent' ELSE 'fetch' END AS outcome,
  CASE WHEN improvable AND NOT login AND outcome = 'already' AND {browser} THEN 'web' WHEN page_route = 'github' AND NOT {code} THEN 'web'
    ELSE page_route END AS route, page_route, page_key, host
FROM (SELECT *, coalesce({_ESC} AND NOT covered, false) AS improvable FROM first_plan)"""


SQL_VIEWS["text_plan"] = _content_sql(True, True, True)
SQL_VIEWS["bare_plan"] = _content_sql(False, False, False)


def text_plan(t: Tables, **tools):
    return planning.content_plan(shape_tabs(t), t.forgotten(), distinct_latest(t), **tools)


_HOST = """CASE route WHEN 'x' THEN 'api.fxtwitter.com' WHEN 'github' THEN 'api.github.com'
  WHEN 'youtube' THEN 'www.youtube.com' ELSE host END"""
_DOC = "CASE WHEN route = page_route THEN page_key ELSE string_split(url, '#')[1] END"


@query("content_plan", f"""
SELECT url, {_HOST} AS host, outcome, route, {_DOC} AS document_key FROM text_plan
WHERE outcome NOT IN ('skip', 'already', 'unsent', 'forgotten', 'not a document')""")
def _content_plan(t):
    return (text_plan(t).where("outcome not in ('skip', 'already', 'unsent', 'forgotten', 'not a document')")
            .select("url", "host", "outcome", "route", "document_key"))


@query("content_plan_outcomes", "SELECT outcome, count(*) AS pages FROM text_plan GROUP BY outcome")
def _content_outcomes(t):
    return text_plan(t).groupBy("outcome").agg(F.count(F.lit(1)).alias("pages"))


@query("content_plan_without_tools", """
SELECT outcome, coalesce(route, '-') AS route, count(*) AS pages FROM bare_plan WHERE outcome IN
('fetch', 'waiting', 'browser waiting') GROUP BY 1, 2""")
def _content_bare(t):
    p = text_plan(t, code_tool=False, video_tool=False, browser=False)
    return (p.where(F.col("outcome").isin("fetch", "waiting", "browser waiting"))
            .groupBy("outcome", F.coalesce("route", F.lit("-")).alias("route")).agg(F.count(F.lit(1)).alias("pages")))


SQL_VIEWS["fetch_once"] = f"""
SELECT *, first_value(url) OVER (PARTITION BY document_key, outcome ORDER BY captured_at DESC, "window", position, url)
  AS fetch_url FROM (SELECT url, outcome, route, captured_at, "window", position, {_DOC} AS document_key, {_HOST} AS host
  FROM text_plan WHERE outcome IN ('fetch', 'render'))"""


def fetch_once(t: Tables):
    # The rules are costly and the plan is read several times below: written once.
    plan = materialise(text_plan(t).where(F.col("outcome").isin("fetch", "render")), "plan")
    return planning.one_fetch_per_document(plan)


@query("one_fetch_per_document", "SELECT url, outcome, document_key, fetch_url FROM fetch_once")
def _once(t):
    return fetch_once(t).select("url", "outcome", "document_key", "fetch_url")


SQL_VIEWS["queued"] = """
SELECT url, route, host, host_place, host || CASE WHEN route = 'github' THEN ' ' || (host_place % 4) ELSE '' END AS queue
FROM (SELECT url, route, host, row_number() OVER (PARTITION BY host ORDER BY captured_at DESC, "window", position, url)
  AS host_place FROM fetch_once WHERE outcome = 'fetch' AND url = fetch_url)"""


@query("schedule_by_host", """
SELECT url, queue, row_number() OVER (PARTITION BY queue ORDER BY host_place) AS queue_place,
  count(*) OVER (PARTITION BY queue) AS queue_size FROM queued""")
def _schedule(t):
    f = materialise(fetch_once(t).where("outcome = 'fetch' and url = fetch_url"), "fetches")
    return planning.schedule_by_host(f).select("url", "queue", "queue_place", "queue_size")


@query("busiest_host_seconds", """
SELECT max(greatest(s - p, 0))::BIGINT AS seconds FROM (SELECT host, sum(CASE route WHEN 'github' THEN 0 WHEN 'youtube' THEN 2
  ELSE 1 END) AS s, max(CASE WHEN route IN ('github', 'youtube') THEN 0 ELSE 1 END) AS p FROM queued GROUP BY host)""")
def _busiest(t):
    return planning.busiest_host_seconds(fetch_once(t).where("outcome = 'fetch' and url = fetch_url"))


@query("image_retries", """
SELECT url FROM first_plan f WHERE outcome = 'fetch' AND status = 'error' AND NOT login AND NOT covered
  AND url NOT IN (SELECT url FROM url_variants WHERE page_id % 4 = 0)""")
def _retries(t):
    latest = distinct_latest(t)
    plan = planning.fetch_plan(shape_tabs(t), t.forgotten(), planning.recorded_state(latest))
    after = t.url_variants().where("page_id % 4 = 0")
    return planning.image_retries(latest, plan, after, t.forgotten()).select("url")


@query("signed_in_eligible_plan", f"""
SELECT url, CASE WHEN covered THEN 'forgotten' WHEN personal THEN 'personal app' WHEN login THEN 'left' ELSE 'render' END AS outcome
FROM planned WHERE skip IS NULL AND status IS NOT NULL AND {_ELIGIBLE.replace('reason', 'why_status')}""")
def _signed_in(t):
    return planning.signed_in_eligible_plan(shape_tabs(t), t.forgotten(), distinct_latest(t)).select("url", "outcome")


@query("http_outcome", """
WITH s AS (SELECT event_id, [200, 204, 301, 401, 403, 404, 410, 429, 500, 502, 503, 504, 418][event_id % 13 + 1] AS s FROM events)
SELECT event_id, CASE WHEN s BETWEEN 200 AND 299 THEN NULL WHEN s = 401 THEN 'behind_login' WHEN s = 403 THEN 'blocked'
  WHEN s IN (404, 410) THEN 'not_found' ELSE 'error' END AS outcome,
  CASE WHEN s BETWEEN 200 AND 299 THEN NULL ELSE s IN (429, 502, 503, 504) END AS passing FROM s""")
def _http(t):
    codes = F.array(*map(F.lit, [200, 204, 301, 401, 403, 404, 410, 429, 500, 502, 503, 504, 418]))
    e = t.raw("events").select("event_id", planning.http_outcome(
        F.get(codes, (F.col("event_id") % 13).cast("int"))).alias("o"))
    return e.select("event_id", "o.outcome", "o.passing")


@query("usable_images", """
WITH s AS (SELECT doc_id, 100 + doc_id * 7 % 900 AS w, 100 + n_chars % 700 AS h FROM documents)
SELECT doc_id, CASE WHEN w < 200 OR h < 200 THEN 'too small' WHEN greatest(w, h) > least(w, h) * 3 THEN 'out of proportion' END
  AS reason FROM s""")
def _usable(t):
    w, h = F.lit(100) + F.col("doc_id") * 7 % 900, F.lit(100) + F.col("n_chars") % 700
    return t.raw("documents").select("doc_id", planning.image_misfit(w, h).alias("reason"))


# Head images: some shared by many pages of one site.
SQL_VIEWS["head_images"] = """
SELECT page_id, url, CASE WHEN page_id % 6 = 0 THEN 'error' ELSE 'ok' END AS status,
  'https://img.example/' || (page_id % 9) || '.png' AS og_image,
  CASE WHEN page_id % 2 = 0 THEN 'https://img.example/t' || (page_id % 5) || '.png' END AS twitter_image FROM pages"""
SQL_VIEWS["page_host"] = "SELECT page_id, regexp_extract(url, '^https?://([^/?#:]*)', 1) AS host FROM pages"
SQL_VIEWS["default_images"] = """
SELECT host, image, count(DISTINCT url) AS pages FROM (SELECT page_id, url, unnest([og_image, twitter_image]) AS image
  FROM head_images WHERE status = 'ok') JOIN page_host USING (page_id) WHERE image IS NOT NULL GROUP BY 1, 2
HAVING count(DISTINCT url) >= 3"""


def head_images(t: Tables):
    p = F.col("page_id")
    img = lambda k, pre="": F.concat(F.lit("https://img.example/" + pre), (p % k).cast("string"), F.lit(".png"))
    return t.raw("pages").select("page_id", "url", F.when(p % 6 == 0, "error").otherwise("ok").alias("status"),
                                 img(9).alias("og_image"), F.when(p % 2 == 0, img(5, "t")).alias("twitter_image"))


@query("site_default_images", "SELECT * FROM default_images")
def _defaults(t):
    return planning.site_default_images(head_images(t))


@query("image_ladder", """
WITH c AS (SELECT page_id, url AS page, unnest([og_image, twitter_image, og_image, 'https://img.example/b' || (page_id % 3),
    'https://img.example/x', 'https://img.example/c', 'https://img.example/p' || page_id]) AS url,
    unnest(['og_image', 'twitter_image', 'body_img', 'body_img', 'x_media', 'body_img', 'page_itself']) AS source,
    unnest(range(7)) AS pos FROM head_images),
r AS (SELECT c.*, CASE source WHEN 'page_itself' THEN 0 WHEN 'x_media' THEN 1 WHEN 'body_img' THEN 3
    ELSE CASE WHEN d.image IS NOT NULL THEN 4 ELSE 2 END END AS rung
  FROM c JOIN page_host USING (page_id) LEFT JOIN default_images d ON d.host = page_host.host AND d.image = c.url
  WHERE c.url IS NOT NULL),
o AS (SELECT page, url, min((rung, pos)) AS k FROM r GROUP BY 1, 2)
SELECT page, url, k[1]::INTEGER AS rung, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY k) AS place FROM o)
WHERE place <= 5""")
def _ladder(t):
    h = head_images(t)
    p = F.col("page_id").cast("string")
    at = lambda s: F.lit("https://img.example/" + s)
    c = h.select(F.col("url").alias("page"), F.posexplode(F.array(
        *[F.struct(u.alias("u"), F.lit(s).alias("s")) for u, s in [
            (F.col("og_image"), "og_image"), (F.col("twitter_image"), "twitter_image"), (F.col("og_image"), "body_img"),
            (F.concat(at("b"), (F.col("page_id") % 3).cast("string")), "body_img"), (at("x"), "x_media"),
            (at("c"), "body_img"), (F.concat(at("p"), p), "page_itself")]])).alias("pos", "c"))
    c = c.select("page", "pos", F.col("c.u").alias("url"), F.col("c.s").alias("source")).where("url is not null")
    return planning.image_ladder(c, planning.site_default_images(h), 5)


@query("prefer_metadata", "SELECT page_id, og_image FROM head_images WHERE status = 'ok'")
def _prefer(t):
    return planning.prefer_metadata(head_images(t)).select("page_id", "og_image")


# Pinned documents: one per document, some in repositories at hand.
SQL_VIEWS["pins"] = """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'kmt-blob:sha256-' || sha256(doc_id::VARCHAR) WHEN doc_id % 29 = 1 THEN 'https://x.example/'
  || doc_id ELSE 'kmt-git:host%2F' || source || '//docs/' || doc_id || '.md' END AS url,
  CASE WHEN doc_id % 7 <> 0 THEN 'blob' || (doc_id % 5) END AS blob, source, text FROM documents"""
SQL_VIEWS["pin_states"] = """
SELECT doc_id, url, text, why, CASE WHEN why IS NULL THEN 'fresh' WHEN why LIKE '%since it was added' THEN 'stale' ELSE 'unresolved' END
  AS state FROM (SELECT *, CASE WHEN url LIKE 'https:%' THEN 'not a source key'
  WHEN url LIKE 'kmt-blob:%' THEN CASE WHEN doc_id % 2 = 0 THEN 'not on the shelf' END
  WHEN source LIKE '%3' THEN 'no checkout of its repository in checkouts.json'
  WHEN blob IS NULL THEN 'its pin names no blob' WHEN doc_id % 11 = 0 THEN 'gone from HEAD since it was added'
  WHEN doc_id % 4 <> 0 THEN 'changed at HEAD since it was added' END AS why FROM pins)"""


def pin_states(t: Tables):
    d, k = t.raw("documents"), F.col("doc_id")
    s = k.cast("string")
    key = (F.when(k % 3 == 0, F.concat(F.lit("kmt-blob:sha256-"), F.sha2(s, 256)))
           .when(k % 29 == 1, F.concat(F.lit("https://x.example/"), s))
           .otherwise(F.concat(F.lit("kmt-git:host%2F"), "source", F.lit("//docs/"), s, F.lit(".md"))))
    blob = F.concat(F.lit("blob"), (k % 5).cast("string"))
    pins = d.select(k, key.alias("url"), F.when(k % 7 != 0, blob).alias("blob"), "text")
    trees = d.where((k % 11 != 0) & ~F.col("source").endswith("3")).select(
        F.concat(F.lit("host/"), "source").alias("repo"), F.concat(F.lit("docs/"), s, F.lit(".md")).alias("path"),
        F.when(k % 4 == 0, blob).otherwise(F.lit("newer")).alias("blob"))
    shelf = d.where(k % 2 == 1).select(F.sha2(s, 256).alias("sha256"))
    return pins, planning.pin_state(pins, trees, shelf)


@query("pin_state", "SELECT url, state, why FROM pin_states")
def _pins(t):
    return pin_states(t)[1]


@query("read_text", """
WITH keys AS (SELECT doc_id AS pos, url FROM pin_states UNION ALL SELECT 1000000 + page_id, url FROM pages)
SELECT k.pos, k.url, CASE WHEN k.url LIKE 'kmt-git:%' THEN 'git' WHEN k.url LIKE 'kmt-blob:%' THEN 'blob' ELSE 'web' END AS kind,
  CASE WHEN refusal IS NULL THEN body END AS text, refusal FROM (
  SELECT k.*, CASE WHEN p.url IS NOT NULL AND k.url NOT LIKE 'https:%' THEN CASE WHEN p.state <> 'unresolved' THEN p.text END
      ELSE CASE WHEN k.pos % 2 = 0 AND k.pos >= 1000000 THEN 'kept ' || k.url END END AS body,
    CASE WHEN k.url IN (SELECT url FROM forgotten) THEN 'it is forgotten; restore it first'
      WHEN k.pos % 5 = 0 THEN 'not a page you added; search lists them'
      WHEN k.url LIKE 'kmt%' THEN CASE WHEN p.state = 'unresolved' THEN p.why END
      WHEN k.pos % 2 = 1 OR k.pos < 1000000 THEN 'no text kept for it' END AS refusal
  FROM keys k LEFT JOIN pin_states p ON p.url = k.url) k""")
def _read(t):
    pins, states = pin_states(t)
    pages = t.raw("pages").select((F.col("page_id") + 1000000).alias("pos"), "url")
    keys = pins.select(F.col("doc_id").alias("pos"), "url").unionByName(pages)
    content = pages.where("pos % 2 = 0").select("url", F.concat(F.lit("kept "), "url").alias("text"))
    resolved = states.join(pins.select("url", "text"), "url")
    return planning.read_text(keys, keys.where("pos % 5 <> 0"), t.forgotten(), content, resolved)
