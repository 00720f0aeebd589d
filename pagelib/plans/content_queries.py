"""Page content over the given HTML, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelib.operators import chunks, content, logs
from pagelib.plans.registry import query
from pagelib.plans.tables import SQL_VIEWS, Tables

_ENTITIES = [("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")]


def _decoded(sql: str) -> str:
    for a, b in _ENTITIES:
        sql = f"regexp_replace({sql}, '{a}?', '{b}', 'g')"
    return sql


_TITLE = "trim(regexp_replace(" + _decoded("regexp_extract(html, '<title>(.*?)</title>', 1)") + ", '\\s+', ' ', 'g'))"
_VISIBLE = ("trim(regexp_replace(" + _decoded(
    "regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), "
    "'<(head|script|style)[^>]*>.*?</(head|script|style)>', ' ', 'gs'), '<[^>]*>', ' ', 'g')") + ", '\\s+', ' ', 'g'))")
_BODY_ONLY = "regexp_replace(html, '<head>.*?</head>', ' ', 's')"


def facts(t: Tables):
    return content.page_facts(t.raw("pages"))


@query("head_metadata", f"""
SELECT page_id, nullif({_TITLE}, '') AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages""")
def _head(t):
    return content.head_metadata(facts(t)).select("page_id", "title", "lang")


# Pages with metadata fields added to their head.
_EXTRA = ("'<head><meta name=\"Description\" content=\" About  ' || page_id || ' \"><meta property=\"og:site_name\" content=\"Site '"
          " || (page_id % 3) || '\"><meta property=\"og:type\" content=\"article\"><meta property=\"og:type\" content=\"website\">"
          "<meta name=\"twitter:image\" content=\"/t/' || page_id || '.jpg\"><link rel=\"canonical\" href=\"/c/' || page_id || '\">"
          "<script type=\"application/ld+json\">{\"@type\": \"Article\", \"isAccessibleForFree\": '"
          " || CASE WHEN page_id % 2 = 0 THEN 'false' ELSE 'true' END || '}</script>'")
_IMGS = ("'<article><img src=\"/a/' || page_id || '.png\" width=\"' || (300 + page_id % 50) || '\" height=\"200\">"
         "<img data-src=\"b.png\" src=\"x.gif\" width=\"640px\" height=\"480\"><img src=\"/logo.png\" width=\"900\" height=\"900\">"
         "<img srcset=\"s-400.jpg 400w, s-800.jpg 800w, s-1600.jpg 1600w\" src=\"s.jpg\"><img src=\"//cdn.example/p.gif\" width=\"1\" height=\"1\">"
         "<img src=\"pic.svg\" width=\"700\" height=\"700\">'")


def rich_pages(t: Tables):
    p = t.raw("pages")
    html = F.expr(f"replace(replace(html, '<head>', {_EXTRA}), '<article>', {_IMGS})")
    return p.select("page_id", "url", html.alias("html"))


@query("head_metadata_fields", """
SELECT page_id, 'About ' || page_id AS description, 'Site ' || (page_id % 3) AS site, 'article' AS kind,
  '/t/' || page_id || '.jpg' AS image, '/c/' || page_id AS canonical, 'Article' AS types, page_id % 2 = 0 AS locked FROM pages""")
def _fields(t):
    h = content.head_metadata(content.page_facts(rich_pages(t)))
    return h.select("page_id", "description", F.col("og")["site_name"].alias("site"), F.col("og")["type"].alias("kind"),
                    F.col("twitter")["image"].alias("image"), "canonical", F.array_join("jsonld_types", ",").alias("types"),
                    content.not_free().alias("locked"))


@query("visible_text", f"SELECT page_id, {_VISIBLE} AS visible FROM pages")
def _visible(t):
    return facts(t).select("page_id", "visible")


@query("image_candidates", """
WITH b AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS o, regexp_extract(url, '^(https?://[^/?#]+/([^?#]*/)?)', 1) AS f FROM pages),
c AS (SELECT page_id, unnest([o || '/t/' || page_id || '.jpg', f || 's-800.jpg', f || 'b.png', o || '/a/' || page_id || '.png']) AS url,
  unnest(['twitter_image', 'body_img', 'body_img', 'body_img']) AS source, unnest(range(4))::INTEGER AS pos FROM b)
SELECT * FROM c WHERE source = 'twitter_image' OR NOT regexp_matches(url, '(^|[^a-z0-9])ads?([^a-z0-9]|$)')""")
def _images(t):
    return content.image_candidates(content.page_facts(rich_pages(t)))


@query("classify_page_html")
def _classify_html(t):
    c = content.main_text(content.classify_pages(content.page_features(content.page_facts(rich_pages(t)))))
    return c.select("page_id", "class", "reason", "visible_chars", "main_chars", F.length("markdown").alias("kept"))


_FEATURES = """SELECT doc_id, doc_id % 13 = 0 AS sign_in, doc_id % 11 = 0 AS password, n_chars % 3000 AS visible_chars,
  doc_id % 3 AS scripts, doc_id % 7 = 0 AS asks_script, doc_id % 5 = 0 AS mount, n_chars * 7 % 4000 AS main_chars,
  doc_id % 4 = 0 AS locked FROM documents"""


@query("classify_pages", f"""
SELECT doc_id, CASE WHEN sign_in OR (password AND visible_chars < 1500) THEN 'behind_login'
  WHEN (visible_chars < 300 AND scripts > 0) OR (visible_chars < 1500 AND asks_script) OR (visible_chars < 300 AND mount)
    THEN 'empty_shell' WHEN main_chars >= 1500 THEN 'ok' WHEN locked THEN 'paywalled' ELSE 'thin' END AS class,
  CASE WHEN sign_in THEN 'sign-in page' WHEN password AND visible_chars < 1500 THEN 'password form'
    WHEN visible_chars < 300 AND scripts > 0 THEN 'drawn by scripts' WHEN visible_chars < 1500 AND asks_script
    THEN 'needs JavaScript' WHEN visible_chars < 300 AND mount THEN 'app shell' WHEN main_chars >= 1500 THEN NULL
    WHEN locked THEN 'paywall' ELSE 'short text' END AS reason FROM ({_FEATURES})""")
def _classify(t):
    features = _FEATURES.replace("FROM documents", "FROM {documents}")
    return content.classify_pages(t.spark.sql(features, documents=t.raw("documents"))).select("doc_id", "class", "reason")


@query("plain_chars", """
SELECT doc_id, length(trim(regexp_replace(regexp_replace(text, '[-#>+*_`~|!\\[\\]\\\\]', '', 'g'), '\\s+', ' ', 'g')))::BIGINT AS chars FROM documents""")
def _plain(t):
    from pagelib.functions import text
    bare = F.regexp_replace("text", r"[-#>+*_`~|!\[\]\\]", "")
    marked = F.concat(F.lit("## **"), bare, F.lit("** [](http://a.example/x_(y))"))
    return t.raw("documents").select("doc_id", text.plain_chars(marked).alias("chars"))


_CAPTURE = """SELECT url, CASE page_id % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'thin' ELSE 'ok' END AS status,
  (page_id * 7) % 1000 AS chars, CASE WHEN page_id % 3 = 0 THEN 'n posts' END AS reason, sha256(page_id::VARCHAR) AS content_sha256
  FROM pages"""


def captures(t: Tables):
    p = F.col("page_id")
    return t.raw("pages").select(
        "url", F.when(p % 5 == 0, "error").when(p % 5 == 1, "thin").otherwise("ok").alias("status"),
        ((p * 7) % 1000).alias("chars"), F.when(p % 3 == 0, "n posts").alias("reason"),
        F.sha2(p.cast("string"), 256).alias("content_sha256"))


@query("keep_longer", f"""
SELECT c.url, taken, CASE WHEN taken THEN c.status ELSE k.status END AS status, CASE WHEN taken THEN c.chars ELSE k.chars END AS chars,
  CASE WHEN taken THEN c.content_sha256 ELSE k.content_sha256 END AS content_sha256,
  CASE WHEN taken THEN c.reason WHEN k.reason = 'HTTP 501' THEN k.reason WHEN k.reason IS NULL THEN 'HTTP 501'
    ELSE k.reason || '; HTTP 501' END AS reason
FROM (SELECT c.*, k.url IS NULL OR (c.chars > coalesce(k.chars, 0) AND c.status <> 'error') AS taken FROM ({_CAPTURE}) c
  LEFT JOIN latest_content k USING (url)) c LEFT JOIN latest_content k USING (url)""")
def _keep_longer(t):
    return content.keep_longer(captures(t), logs.latest_by_key(t.content_log()), "HTTP 501")


@query("keep_content", """
SELECT url, sha256(url) AS file_key, content_sha256 FROM content_log c WHERE seq % 2 = 0 AND NOT EXISTS (
  SELECT 1 FROM latest_content l WHERE l.url = c.url AND l.content_sha256 = c.content_sha256)""")
def _keep(t):
    log = t.content_log()
    return content.keep_content(log.where("seq % 2 = 0"), logs.latest_by_key(log)).select("url", "file_key", "content_sha256")


def bodies(t: Tables):
    d = t.raw("documents")
    return d.select(F.col("doc_id").cast("string").alias("page_id"), F.col("source").alias("title"),
                    F.concat(F.lit("# "), "source", F.lit("\n\n"), F.regexp_replace("text", "\n", "\n\n")).alias("body"))


@query("chunk_pages")
def _chunks(t):
    return chunks.chunk_pages(bodies(t)).select("id", "page_id", "start", "end", "section", "hash")


@query("incremental_chunks", """
SELECT doc_id::VARCHAR AS page_id, sha256(json_array(source, text)::VARCHAR) AS page_hash FROM documents WHERE doc_id % 4 <> 0""")
def _incremental(t):
    d = t.raw("documents")
    now = d.select(F.col("doc_id").cast("string").alias("page_id"), F.col("source").alias("title"), F.col("text").alias("body"))
    old = now.where("page_id % 4 = 0").select(
        "page_id", chunks.page_hash(F.col("title"), F.col("body")).alias("page_hash"), F.lit("id").alias("id"))
    return content.incremental_chunks(now, old)[1].select("page_id", "page_hash")


@query("github_topics", """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'spark,page-' || page_id ELSE 'named' END AS topics,
  'Read "me" ' || page_id || ' now' AS readme FROM pages""")
def _topics(t):
    p = t.raw("pages")
    data = F.expr("""concat('{"topics":[', CASE WHEN page_id % 2 = 0 THEN concat('"spark","page-', page_id, '"')
      ELSE '{"name":"named"}' END, '],"readme":{"richText":"<p>Read \\\\"me\\\\"</p>\\\\n<b>', page_id, '</b> now"}}')""")
    return content.github_topics(p.select("page_id", data.alias("html"))).select(
        "page_id", F.array_join("topics", ",").alias("topics"), "readme")


# Cues of eight words, each starting with the second half of the one before.
SQL_VIEWS["cues"] = """
SELECT doc_id AS video, i AS seq, (i * 2)::DOUBLE AS start, (i * 2 + 1 + doc_id % 3)::DOUBLE AS stop, doc_id % 2 = 0 AS rolling,
  words[i * 4 + 1 : i * 4 + 8] AS words FROM (SELECT doc_id, words, unnest(range(greatest(len(words) // 4, 1))) AS i FROM
  (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS words FROM documents))"""


def cues(t: Tables):
    d = t.raw("documents").select(F.col("doc_id").alias("video"), F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("w"))
    n = F.greatest(F.floor(F.size("w") / 4), F.lit(1)).cast("int")
    i = F.col("seq")
    # A cue carries its own words only, not the document's.
    said = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.array_join(F.slice("w", k * 4 + 1, F.lit(8)), " "))
    c = d.select("video", F.posexplode(said).alias("at", "text")).withColumn("seq", F.col("at").cast("long"))
    return c.select("video", "seq", (i * 2).cast("double").alias("start"),
                    (i * 2 + 1 + F.col("video") % 3).cast("double").alias("end"), (F.col("video") % 2 == 0).alias("rolling"), "text")


@query("dedupe_captions", """
WITH p AS (SELECT *, lag(words) OVER w AS prev, lag(stop) OVER w AS prev_stop FROM cues WHERE len(words) > 0
  WINDOW w AS (PARTITION BY video ORDER BY seq)),
s AS (SELECT *, CASE WHEN start < prev_stop OR (rolling AND start <= prev_stop) THEN coalesce(list_filter(
  range(least(len(words), len(prev)), 0, -1), lambda n: words[1:n] = prev[len(prev) - n + 1 : len(prev)])[1], 0) ELSE 0 END AS shared FROM p)
SELECT video, seq, start, stop AS "end", array_to_string(words[shared + 1 : len(words)], ' ') AS said FROM s WHERE shared < len(words)""")
def _captions(t):
    return content.dedupe_captions(cues(t))


@query("chapter_of", """
WITH l AS (SELECT user_id AS video, event_id AS seq, epoch(ts)::DOUBLE AS start FROM events WHERE event_type <> 'purchase'),
c AS (SELECT user_id AS video, floor(epoch(ts))::DOUBLE AS start FROM events WHERE event_type = 'purchase')
SELECT l.video, l.seq, coalesce((SELECT max(start) FROM c WHERE c.video = l.video AND c.start <= l.start),
  (SELECT min(start) FROM c WHERE c.video = l.video)) AS chapter_start FROM l""")
def _chapters(t):
    e = t.raw("events")
    at = F.col("ts").cast("double")
    lines = e.where("event_type <> 'purchase'").select(F.col("user_id").alias("video"), F.col("event_id").alias("seq"), at.alias("start"))
    chapters = e.where("event_type = 'purchase'").select(F.col("user_id").alias("video"), F.floor(at).cast("double").alias("start"))
    return content.chapter_of(lines, chapters).select("video", "seq", "chapter_start")


_KEYS = "['en', 'en-US', 'en-orig', 'pt-BR', 'pt', 'fr-orig', 'de', 'a.t']"
SQL_VIEWS["caption_tracks"] = f"""
SELECT doc_id // 4 AS video, CASE WHEN doc_id % 3 = 0 THEN 'manual' ELSE 'automatic' END AS kind, {_KEYS}[doc_id * 5 % 8 + 1] AS key,
  CASE WHEN doc_id % 7 = 0 THEN 'srv3' ELSE 'vtt' END AS ext,
  'https://v.example/' || CASE WHEN doc_id % 11 = 0 THEN '?tlang=en' ELSE '' END AS url FROM documents"""
SQL_VIEWS["caption_videos"] = "SELECT DISTINCT doc_id // 4 AS video, CASE WHEN doc_id // 4 % 3 = 0 THEN 'pt-PT' END AS language FROM documents"


@query("choose_captions", """
WITH k AS (SELECT video, kind, key, bool_or(ext = 'vtt') AS vtt, bool_or(url LIKE '%tlang=%') AS tl,
  lower(regexp_extract(regexp_replace(key, '-orig$', ''), '^[^-_]*')) AS lang FROM caption_tracks GROUP BY ALL),
h AS (SELECT video, arg_min(lang, key) AS heard FROM k WHERE kind = 'automatic' AND key LIKE '%-orig' GROUP BY video),
v AS (SELECT video, coalesce(lower(regexp_extract(language, '^[^-_]*')), heard) AS own FROM caption_videos LEFT JOIN h USING (video)),
r AS (SELECT k.*, CASE WHEN lang = 'en' THEN 0 WHEN lang = own THEN 1 END AS wanted, CASE WHEN kind = 'manual' THEN
  CASE WHEN key = lang THEN 0 ELSE 1 END WHEN key = lang || '-orig' THEN 2 WHEN key = lang THEN 3 ELSE 4 END AS place
  FROM k JOIN v USING (video) WHERE vtt AND regexp_matches(key, '^[A-Za-z0-9_][A-Za-z0-9_-]*$') AND (kind = 'manual' OR NOT tl))
SELECT video, arg_min(key, (wanted, place, key)) AS key, arg_min(kind, (wanted, place, key)) AS kind FROM r
WHERE wanted IS NOT NULL GROUP BY video""")
def _choose(t):
    d, k = t.raw("documents"), F.col("doc_id")
    keys = F.array(*map(F.lit, ["en", "en-US", "en-orig", "pt-BR", "pt", "fr-orig", "de", "a.t"]))
    video = F.floor(k / 4)
    tracks = d.select(video.alias("video"), F.when(k % 3 == 0, "manual").otherwise("automatic").alias("kind"),
                      F.get(keys, (k * 5 % 8).cast("int")).alias("key"), F.when(k % 7 == 0, "srv3").otherwise("vtt").alias("ext"),
                      F.concat(F.lit("https://v.example/"), F.when(k % 11 == 0, "?tlang=en").otherwise("")).alias("url"))
    videos = d.select(video.alias("video"), F.when(video % 3 == 0, "pt-PT").alias("language")).distinct()
    return content.choose_captions(tracks, videos)


# Threads: one per conversation, a post per turn, some with mistakes.
def posts(t: Tables):
    c, n = F.col("conv_id"), F.col("turn")
    some = lambda cond, v: F.when(cond, v)
    none = F.array().cast("array<string>")
    return t.raw("conversations").select(
        c.alias("thread"), n.alias("pos"), F.concat((c * 100 + F.when(c % 9 == 0, 0).otherwise(n)).cast("string"),
                                                    F.when(c % 8 == 5, "x").otherwise("")).alias("id"),
        F.when((c % 11 == 3) & (n == 1), "other").otherwise("Writer").alias("handle"),
        F.concat(F.lit("Name "), c.cast("string")).alias("name"), F.lit("2026-10-07T09:00:00Z").alias("at"),
        F.lit("en").alias("lang"), F.when((c % 7 == 2) & (n == 0), " ").otherwise(F.col("text")).alias("text"),
        (c % 6 != 1).alias("text_complete"), F.when(n == 0, F.array(F.lit("a picture"))).otherwise(none).alias("alts"),
        none.alias("media"), F.array(F.struct(
            F.when(c % 13 == 4, "ftp://x").otherwise("https://t.co/a").alias("href"),
            F.when(c % 10 != 7, "https://a.example/").alias("target"))).alias("links"),
        some((c % 5 == 0) & (n == 0), F.concat(F.lit("Article "), c.cast("string"))).alias("article_title"),
        F.when((c % 5 == 0) & (n == 0), F.array(F.lit("One."), F.lit("Two."))).otherwise(none).alias("article_parts"),
        some(n == 1, F.lit("quoted")).alias("quote_handle"), some(n == 1, F.lit("line one\n\nline two")).alias("quote_text"),
        some((c % 4 == 1) & (n == 2), F.lit("post deleted")).alias("unavailable"))


@query("check_threads", """
SELECT conv_id AS thread, count(*) AS posts, CASE WHEN conv_id % 12 = 11 THEN 'where: nowhere'
  WHEN count(*) > 50 THEN 'posts: more than 50'
  WHEN conv_id % 8 = 5 THEN 'post id: ' || (conv_id * 100 + CASE WHEN conv_id % 9 = 0 THEN 0 ELSE min(turn) END) || 'x'
  WHEN conv_id % 13 = 4 THEN 'links'
  WHEN conv_id % 11 = 3 AND count(*) FILTER (turn = 1) > 0 THEN 'not the author''s'
  WHEN conv_id % 9 = 0 AND count(*) > 1 THEN 'posts: ' || (conv_id * 100) || ' twice' END AS refused
FROM conversations GROUP BY conv_id""")
def _check(t):
    c = F.col("conv_id")
    threads = t.raw("conversations").groupBy(c.alias("thread")).agg(F.min("turn").alias("m")).select(
        "thread", (F.col("thread") * 100 + F.when(F.col("thread") % 9 == 0, 0).otherwise(F.col("m"))).cast("string").alias("clicked0"))
    th = F.col("thread")
    threads = threads.select("thread", F.concat("clicked0", F.when(th % 8 == 5, "x").otherwise("")).alias("clicked"),
                             F.lit("WRITER").alias("handle"), F.when(th % 12 == 11, "nowhere").otherwise("status").alias("place"),
                             F.lit(True).alias("complete"), F.array().cast("array<string>").alias("reasons"))
    return content.check_threads(posts(t), threads, {"posts": 50}).select("thread", "posts", "refused")


_SECTION = """CASE WHEN conv_id % 4 = 1 AND turn = 2 THEN 'Post deleted.' ELSE concat_ws(chr(10) || chr(10),
  'Name ' || conv_id || ' (@' || CASE WHEN conv_id % 11 = 3 AND turn = 1 THEN 'other' ELSE 'Writer' END || '), 2026-10-07T09:00:00Z',
  CASE WHEN conv_id % 7 = 2 AND turn = 0 THEN NULL ELSE nullif(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '') END,
  CASE WHEN conv_id % 5 = 0 AND turn = 0 THEN 'One.' || chr(10) || chr(10) || 'Two.' END, CASE WHEN turn = 0 THEN 'Image: a picture' END,
  CASE WHEN turn = 1 THEN '> Quoting @quoted' || chr(10) || '>' || chr(10) || '> line one' || chr(10) || '>' || chr(10) || '> line two' END) END"""


@query("thread_text", f"""
SELECT conv_id AS thread, arg_min(CASE WHEN conv_id % 5 = 0 AND turn = 0 THEN 'Article ' || conv_id ELSE 'Name ' || conv_id || ' (@'
    || CASE WHEN conv_id % 11 = 3 AND turn = 1 THEN 'other' ELSE 'Writer' END || ') on X' END, turn) AS title,
  count(*) AS posts, CASE WHEN bool_or(trim(CASE WHEN conv_id % 7 = 2 AND turn = 0 THEN ' ' ELSE text END) <> ''
    AND NOT (conv_id % 4 = 1 AND turn = 2)) THEN 'ok' ELSE 'thin' END AS status,
  '# ' || title || chr(10) || chr(10) || regexp_replace(string_agg({_SECTION}, chr(10) || chr(10) || '---' || chr(10) || chr(10)
    ORDER BY turn), '\\s+$', '') || chr(10) AS markdown
FROM conversations GROUP BY conv_id""")
def _thread(t):
    return content.thread_text(posts(t))


_META_TEXT = """concat_ws(chr(10), CASE WHEN page_id % 2 = 0 THEN 'page title: T ' || page_id END,
  'description: ' || CASE WHEN page_id % 3 = 0 THEN 'own ' || page_id WHEN page_id % 3 = 1 THEN 'og ' || page_id ELSE 'tw' END,
  CASE WHEN page_id % 4 = 0 THEN 'site: Site' END, CASE WHEN page_id % 5 = 0 THEN 'kind: Article, News' WHEN page_id % 5 = 1 THEN 'kind: video' END,
  CASE WHEN page_id % 6 = 0 THEN 'topics: a, b' END, CASE WHEN page_id % 6 = 1 THEN 'readme: ' || trim(repeat('long ', 400)) END)"""


@query("metadata_text", f"SELECT page_id, {_META_TEXT} AS lines FROM pages")
def _metadata_text(t):
    from pagelib.functions import text
    p = F.col("page_id")
    s = p.cast("string")
    say = lambda cond, v: F.when(cond, v)
    none = F.lit(None).cast("string")
    meta = F.struct(
        F.concat(F.when(p % 2 == 0, " T  ").otherwise("Page "), s).alias("title"),
        F.when(p % 3 == 0, F.concat(F.lit("own  "), s)).otherwise(" ").alias("description"),
        F.struct(say(p % 3 == 1, F.concat(F.lit("og "), s)).alias("description"), say(p % 4 == 0, F.lit(" Site ")).alias("site_name"),
                 F.when(p % 5 == 1, "video").otherwise("website").alias("type")).alias("og"),
        F.struct(F.lit("tw").alias("description")).alias("twitter"),
        F.when(p % 5 == 0, F.array(F.lit("Article"), F.lit("News"))).otherwise(F.array().cast("array<string>")).alias("jsonld_types"),
        F.struct(F.when(p % 6 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("topics"),
                 F.when(p % 6 == 1, F.repeat(F.lit("long "), 400)).otherwise(none).alias("readme")).alias("github"))
    return t.raw("pages").select("page_id", text.metadata_text(F.concat(F.lit("page "), s), meta).alias("lines"))
