"""Web page content: facts of HTML, classes, text, images, captions, threads; chunks are in `chunks`."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pagelib.functions import html_facts, ordered, text, urls
from pagelib.functions.ordered import Coarse
from pagelib.operators.chunks import page_hash

ENOUGH, SHELL = 1500, 300
SLICE = 100
# Phrases and words the classes look for.
SIGN_IN = r"(?<![\p{L}\p{N}])(sign in|signin|sign-in|log in|login|log-in)(?![\p{L}\p{N}])"
NEEDS_SCRIPT = (r"(?s)(enable|require|turn on).{0,60}?javascript|javascript.{0,60}?(disabled|required)")
NOT_SUBJECT = ["logo", "icon", "favicon", "avatar", "sprite", "badge", "emoji", "pixel", "spacer", "ad", "advert",
               "tracking", "tracker", "shields"]
SRCSET_WIDTH = 768
HEAD_IMAGES = [("og:image:secure_url", "og_image"), ("og:image", "og_image"), ("og:image:url", "og_image"),
               ("twitter:image", "twitter_image"), ("twitter:image:src", "twitter_image")]


def page_facts(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One pass over every page's HTML; the pages stream through in Arrow batches."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), SLICE):     # parsed pages are passed on in small slices
                part = batch.iloc[start:start + SLICE]
                rows = pd.DataFrame([html_facts.facts(h) for h in part["html"]])
                for c in batch.columns:
                    if c != "html":
                        rows[c] = part[c].values
                yield rows

    source = pages.select(key, "url", F.col(html).alias("html"))
    kind = pages.schema[key].dataType.simpleString()
    return source.mapInPandas(read, f"{html_facts.FACTS_SCHEMA}, {key} {kind}, url string")


def first_meta(key: str) -> Column:
    return F.get(F.filter("meta", lambda m: m["key"] == key), F.lit(0))["content"]


def _prefixed(prefix: str) -> Column:
    named = F.filter("meta", lambda m: m["key"].startswith(prefix))
    return F.map_from_entries(F.array_distinct(F.transform(named, lambda m: F.struct(
        F.substr(m["key"], F.lit(len(prefix) + 1)).alias("key"),
        F.get(F.filter(named, lambda o: o["key"] == m["key"]), F.lit(0))["content"].alias("value")))))


def jsonld_types(jsonld: str = "jsonld") -> Column:
    """Types of what each block describes: its `@type`, of the block, an item or a `@graph` item."""
    found = F.flatten(F.transform(jsonld, lambda b: F.regexp_extract_all(b, F.lit(r'"@type"\s*:\s*"([^"]+)"'), F.lit(1))))
    return F.array_distinct(found)


def head_metadata(facts: DataFrame) -> DataFrame:
    """Title, language, canonical address and the meta fields of each page."""
    return facts.withColumns({
        "description": text.collapse(first_meta("description")),
        "og": _prefixed("og:"), "twitter": _prefixed("twitter:"), "jsonld_types": jsonld_types()})


def not_free(jsonld: str = "jsonld") -> Column:
    free = F.exists(jsonld, lambda b: b.rlike(r'(?i)"isAccessibleForFree"\s*:\s*"?false'))
    locked = F.exists("meta", lambda m: (m["key"] == "article:content_tier") & (F.lower(m["content"]) == "locked"))
    return F.coalesce(free | locked, F.lit(False))


def page_features(facts: DataFrame) -> DataFrame:
    """The columns the classes are decided from."""
    described = first_meta("description").isNotNull() | first_meta("og:description").isNotNull()
    article, whole = text.plain_chars("article"), text.plain_chars("page")
    visible = F.length("visible")
    use_whole = (article < ENOUGH) & ((visible >= ENOUGH) | (article == 0)) & (whole > article)
    return facts.withColumns({
        "sign_in": F.coalesce(F.lower("title").rlike(SIGN_IN) & ~described, F.lit(False)),
        "visible_chars": visible, "asks_script": F.lower("visible").rlike(NEEDS_SCRIPT),
        "main_chars": F.when(use_whole, whole).otherwise(article),
        "body": F.when(use_whole, F.col("page")).otherwise(F.col("article")), "locked": not_free()})


def classify_pages(features: DataFrame) -> DataFrame:
    """First rule that holds: (class, reason)."""
    v = F.col("visible_chars")

    def said(kind: str, reason: str | None) -> Column:
        return F.struct(F.lit(kind).alias("class"), F.lit(reason).cast("string").alias("reason"))

    rule = (F.when(F.col("sign_in"), said("behind_login", "sign-in page"))
            .when(F.col("password") & (v < ENOUGH), said("behind_login", "password form"))
            .when((v < SHELL) & (F.col("scripts") > 0), said("empty_shell", "drawn by scripts"))
            .when((v < ENOUGH) & F.col("asks_script"), said("empty_shell", "needs JavaScript"))
            .when((v < SHELL) & F.col("mount"), said("empty_shell", "app shell"))
            .when(F.col("main_chars") >= ENOUGH, said("ok", None))
            .when(F.col("locked"), said("paywalled", "paywall")).otherwise(said("thin", "short text")))
    return features.withColumn("verdict", rule).select("*", "verdict.class", "verdict.reason").drop("verdict")


def main_text(features: DataFrame) -> DataFrame:
    """The kept text: `# Title` once, then the body."""
    body = F.trim(F.col("body"))
    heading = F.concat(F.lit("# "), F.col("title"))
    return features.withColumn("markdown", F.when(body == "", "").when(
        F.col("title").isNotNull() & ~body.startswith(heading), F.concat(heading, F.lit("\n\n"), body, F.lit("\n")))
        .otherwise(F.concat(body, F.lit("\n"))))


def resolve(base: Column, raw: Column) -> Column:
    """Absolute web address of a link on a page, NULL for other schemes."""
    def at(p: Column) -> Column:
        r, base = p["raw"], p["base"]
        origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
        folder = F.regexp_extract(base, r"^(https?://[^/?#]+(?:/[^?#]*/|/)?)", 1)
        return (F.when(r.isNull() | (r == ""), F.lit(None)).when(r.rlike(r"^(?i)https?://[^/?#]"), r)
                .when(r.startswith("//"), F.concat(F.regexp_extract(base, r"^(https?:)", 1), r))
                .when(r.startswith("/"), F.concat(origin, r)).when(r.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None))
                .otherwise(F.concat(F.when(folder == origin, F.concat(folder, F.lit("/"))).otherwise(folder), r)))

    return urls.let(F.struct(base.alias("base"), F.trim(raw).alias("raw")), at)


def choose_srcset(value: Column) -> Column:
    """Struct (url, widest): the smallest entry at least 768 wide, else the widest, else the densest."""
    entries = F.filter(F.transform(F.split(value, r",\s+|,$|\s+,"), lambda e: F.trim(e)), lambda e: e != "")
    parsed = F.transform(entries, lambda e: F.struct(
        F.regexp_extract(e, r"\s(\d+)w$", 1).try_cast("int").alias("w"),
        F.coalesce(F.regexp_extract(e, r"\s([0-9.]+)x$", 1).try_cast("double"), F.lit(1.0)).alias("x"),
        F.regexp_extract(e, r"^(\S+)", 1).alias("u")))
    def choose(entries: Column) -> Column:
        widths = F.filter(entries, lambda p: p["w"].isNotNull())
        wide = F.array_min(F.filter(widths, lambda p: p["w"] >= SRCSET_WIDTH))
        dense = F.array_max(F.transform(F.filter(entries, lambda p: p["w"].isNull()),
                                        lambda p: F.struct(p["x"].alias("x"), p["u"].alias("u"))))
        return F.struct(F.coalesce(wide["u"], F.array_max(widths)["u"], dense["u"]).alias("url"),
                        F.array_max(widths)["w"].alias("widest"))

    return urls.let(parsed, choose)


def image_candidates(facts: DataFrame, key: str = "page_id") -> DataFrame:
    """(page, url, source, pos): head images in trust order, then the page's own by declared area."""
    head = F.array_compact(F.concat(
        F.array(*[F.when(first_meta(k).isNotNull(), F.struct(first_meta(k).alias("raw"), F.lit(s).alias("source")))
                  for k, s in HEAD_IMAGES]),
        F.transform(F.flatten(F.transform("jsonld", lambda b: F.regexp_extract_all(
            b, F.lit(r'"(?:image|thumbnailUrl|contentUrl)"\s*:\s*\[?\s*(?:\{[^}]*?"url"\s*:\s*)?"([^"]+)"'), F.lit(1)))),
            lambda u: F.struct(u.alias("raw"), F.lit("jsonld_image").alias("source"))),
        F.array(F.when(first_meta("image").isNotNull(),
                       F.struct(first_meta("image").alias("raw"), F.lit("itemprop_image").alias("source"))))))
    heads = facts.select(key, "url", F.posexplode(head).alias("at", "h")).select(
        key, resolve(F.col("url"), F.col("h.raw")).alias("image"), F.col("h.source").alias("source"),
        F.lit(0).alias("part"), F.lit(0).cast("long").alias("area"), "at")
    own = facts.select(key, "url", F.posexplode("images").alias("at", "i"))
    attr = lambda n: F.nullif(F.col("i")[n], F.lit(""))
    own = own.withColumn("set", choose_srcset(F.coalesce(attr("data-srcset"), attr("srcset"), F.lit(""))))
    src = F.coalesce(F.when(resolve(F.col("url"), attr("data-src")).isNotNull(), attr("data-src")), attr("src"))
    pixels = lambda n: F.regexp_extract(F.trim(attr(n)), r"^(\d+)\s*(?:px)?$", 1).try_cast("long")
    w, h = pixels("width"), pixels("height")
    named = F.split(F.lower(F.concat_ws(" ", attr("class"), attr("id"), attr("alt"), src, "image")), r"[^\p{L}\p{N}]+")
    other = F.exists(named, lambda t: F.regexp_replace(t, "s$", "").isin(NOT_SUBJECT) | t.isin(NOT_SUBJECT))
    own = own.withColumn("image", F.coalesce(resolve(F.col("url"), F.col("set.url")), resolve(F.col("url"), src)))
    own = own.where(F.col("image").isNotNull() & ~other & (F.coalesce(w, F.lit(2)) > 1) & (F.coalesce(h, F.lit(2)) > 1)
                    & ~F.lower(urls.path_of("image")).endswith(".svg"))
    area = F.coalesce(w * h, (F.col("set.widest").cast("long") * F.col("set.widest")), F.lit(-1))
    body = own.select(key, "image", F.lit("body_img").alias("source"), F.lit(1).alias("part"), area.alias("area"), "at")
    found = heads.where(F.col("image").isNotNull()).unionByName(body)
    # The images of one page are one document's tags; pages spread over tasks.
    from pyspark.sql import Window
    order = Window.partitionBy(key).orderBy("part", F.desc("area"), "at")
    return found.select(key, F.col("image").alias("url"), "source", (F.row_number().over(order) - 1).alias("pos"))


def github_topics(pages: DataFrame, html: str = "html") -> DataFrame:
    """Topics and readme text a repository page embeds."""
    items = F.from_json(F.concat(F.lit("["), F.regexp_extract(html, r'"topics":\[([^\]]*)\]', 1), F.lit("]")), "array<string>")
    topics = F.transform(items, lambda i: F.coalesce(F.get_json_object(i, "$.name"), i))
    rich = F.regexp_extract(html, r'"richText":("(?:[^"\\]++|\\.)*+")', 1)
    decoded = F.get_json_object(F.concat(F.lit('{"t":'), F.when(rich == "", '""').otherwise(rich), F.lit("}")), "$.t")
    readme = text.collapse(F.regexp_replace(decoded, r"<[^>]*>", " "))
    return pages.withColumns({"topics": topics, "readme": readme})


def keep_longer(captures: DataFrame, kept: DataFrame, note: str) -> DataFrame:
    """A capture replaces a kept text only if it is longer and did not fail.

    Else the page's line is copied, its reason extended by `note` once.
    """
    k = kept.select("url", *[F.col(c).alias(f"kept_{c}") for c in ("status", "chars", "reason", "content_sha256")])
    j = captures.join(k, "url", "left")
    failed = F.col("status").isin("error", "unavailable", "skipped")
    longer = (F.col("chars") > F.coalesce("kept_chars", F.lit(0))) & ~failed
    takes = F.col("kept_content_sha256").isNull() | longer
    said = F.array_contains(F.split(F.coalesce("kept_reason", F.lit("")), "; "), note)
    extended = F.when(said, F.col("kept_reason")).otherwise(F.concat_ws("; ", "kept_reason", F.lit(note)))
    pick = lambda c: F.when(takes, F.col(c)).otherwise(F.col(f"kept_{c}")).alias(c)
    return j.select("url", takes.alias("taken"), pick("status"), pick("chars"), pick("content_sha256"),
                    F.when(takes, F.col("reason")).otherwise(extended).alias("reason"))


def keep_content(captures: DataFrame, stored: DataFrame) -> DataFrame:
    """What to write to the keyed store: new and changed texts only.

    The file key is the address's SHA-256; an equal body hash means nothing to write.
    """
    c = captures.withColumn("file_key", F.sha2("url", 256))
    return c.join(stored.select("url", "content_sha256"), ["url", "content_sha256"], "left_anti")


def incremental_chunks(content: DataFrame, prior: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, changed): chunk rows of unchanged pages, and the pages to cut again."""
    now = content.withColumn("page_hash", page_hash(F.col("title"), F.col("body")))
    known = prior.select("page_id", "page_hash").distinct()
    single = known.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("page_id")
    same = now.join(known, ["page_id", "page_hash"], "left_semi").join(single, "page_id", "left_semi").select("page_id")
    return prior.join(same, "page_id", "left_semi"), now.join(same, "page_id", "left_anti")


# --- captions

def dedupe_captions(cues: DataFrame) -> DataFrame:
    """Automatic cues without the words they repeat from the cue before.

    `cues` has (video, seq, start, end, rolling, text). When a cue overlaps the one
    before (or touches it in the rolling layout) the longest start of it that ends
    the earlier cue is dropped.
    """
    c = cues.where(F.col("text").rlike(r"\S"))
    # Texts travel, and are cut into words where they are compared.
    prev = ordered.lag(c, ["video"], [F.col("seq")], ["seq"], [Coarse(ordered.id_bucket("seq", 4096))], "prev",
                       F.struct("text", "end"))
    overlaps = (F.col("start") < F.col("prev.end")) | (F.col("rolling") & (F.col("start") <= F.col("prev.end")))
    words = lambda t: F.filter(F.split(t, r"\s+"), lambda w: w != "")
    pair = F.struct(words("text").alias("now"), F.when(overlaps, words("prev.text")).otherwise(F.array().cast("array<string>")).alias("prev"))

    def left(x: Column) -> Column:
        now, before = x["now"], x["prev"]
        n_before = F.size(before)
        most = F.least(F.size(now), n_before)
        sizes = F.when(most > 0, F.sequence(most, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        # The last words are compared first: few lengths get further.
        shared = F.filter(sizes, lambda n: (F.get(now, n - 1) == F.get(before, n_before - 1))
                          & (F.slice(now, F.lit(1), n) == F.slice(before, n_before - n + 1, n)))
        return F.array_join(F.slice(now, F.coalesce(F.get(shared, F.lit(0)), F.lit(0)) + 1, F.size(now)), " ")

    # One element arrays bind a row's words, so that they are not cut again for each use.
    said = F.filter(F.transform(F.array(pair), left), lambda s: s != "")
    return prev.select("video", "seq", "start", "end", F.explode(said).alias("said"))


def chapter_of(lines: DataFrame, chapters: DataFrame) -> DataFrame:
    """Each line with its chapter: the last one begun, the first for earlier lines.

    Lines and chapter starts are put on one time line and the latest start is
    carried forward, so no range join is needed.
    """
    first = chapters.groupBy("video").agg(F.min("start").alias("first_start"))
    starts = chapters.select("video", F.col("start").alias("at"), F.lit(None).cast("long").alias("seq"),
                             F.col("start").alias("chapter"), F.lit(0).alias("side"))
    events = lines.select("video", F.col("start").alias("at"), "seq", F.lit(None).cast("double").alias("chapter"),
                          F.lit(1).alias("side")).unionByName(starts)
    carried = ordered.running(events, ["video"], [F.col("at"), F.col("side"), F.col("seq")],
                              [Coarse(F.floor(F.col("at") / 600))], "chapter_start", F.col("chapter"), "max")
    out = carried.where(F.col("side") == 1).select("video", "seq", "chapter_start")
    return (lines.join(out, ["video", "seq"]).join(first, "video", "left")
            .withColumn("chapter_start", F.coalesce("chapter_start", "first_start")).drop("first_start"))


def choose_captions(tracks: DataFrame, videos: DataFrame) -> DataFrame:
    """The caption track of each video.

    `tracks` has (video, kind ∈ manual/automatic, key, ext, url), `videos` (video,
    language). English first, then the stated or original language; in each a
    person's track (plain code, then regional) before the automatic one (original,
    plain, other). Only WebVTT counts, translations never do.
    """
    primary = lambda c: F.lower(F.regexp_extract(c, r"^([^-_]*)", 1))
    original = F.col("key").endswith("-orig")
    base = F.when(original, F.regexp_replace("key", "-orig$", "")).otherwise(F.col("key"))
    t = tracks.withColumns({"original": original, "lang": primary(base)})
    heard = t.where(original & (F.col("kind") == "automatic")).groupBy("video").agg(
        F.min_by("lang", "key").alias("heard"))
    v = videos.join(heard, "video", "left").withColumn(
        "own", F.coalesce(F.nullif(primary(F.col("language")), F.lit("")), "heard")).select("video", "own")
    keys = t.groupBy("video", "kind", "key", "original", "lang").agg(
        F.bool_or(F.col("ext") == "vtt").alias("vtt"), F.bool_or(F.col("url").contains("tlang=")).alias("translated"))
    usable = F.col("vtt") & F.col("key").rlike(r"^[A-Za-z0-9_][A-Za-z0-9_-]*$") & (
        (F.col("kind") == "manual") | ~F.col("translated"))
    j = keys.where(usable).join(v, "video")
    wanted = F.when(F.col("lang") == "en", 0).when(F.col("lang") == F.col("own"), 1)
    plain = F.col("key") == F.col("lang")
    place = (F.when(F.col("kind") == "manual", F.when(plain, 0).otherwise(1))
             .when(F.col("original") & (F.col("key") == F.concat("lang", F.lit("-orig"))), 2).when(plain, 3).otherwise(4))
    best = j.where(wanted.isNotNull()).groupBy("video").agg(
        F.min(F.struct(wanted.alias("wanted"), place.alias("place"), "key", "kind")).alias("b"))
    return best.select("video", F.col("b.key").alias("key"), F.col("b.kind").alias("kind"))


# --- threads

REASONS = ["timeline", "unexpanded_replies", "text_truncated", "recommendation_boundary", "unresolved_link",
           "missing_identity"]


def check_threads(posts: DataFrame, threads: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """The first reason each thread is refused, or whether it is complete.

    Sizes refuse a thread only where `limits` names them: posts, text (characters of a text or description), name,
    alts, media, links.

    `threads` has (thread, clicked, handle, place, complete, reasons); `posts` (thread,
    pos, id, handle, name, at, lang, text, text_complete, alts, media, links) with links
    (href, target).
    """
    t = threads.select("thread", "clicked", F.lower("handle").alias("author"), "place", "complete", "reasons")
    j = posts.join(t.select("thread", "author", "clicked"), "thread")
    web = lambda c: urls.is_web(c)
    limits = limits or {}
    over = lambda size, name: size > limits[name] if name in limits else F.lit(False)
    bad_link = F.exists("links", lambda l: ~web(l["href"]) | (l["target"].isNotNull() & ~web(l["target"])))
    problem = (F.when(~F.col("id").rlike(r"^[0-9]{1,19}$"), F.concat(F.lit("post id: "), "id"))
               .when(F.lower("handle") != F.col("author"), "not the author's")
               .when(F.col("at").isNotNull() & F.col("at").try_cast("timestamp").isNull(), "at is not RFC 3339")
               .when(~F.coalesce("lang", F.lit("")).rlike(r"^[A-Za-z0-9-]{0,35}$"), "lang")
               .when(over(F.length("text"), "text") | over(F.length("name"), "name"), "text or name too long")
               .when(over(F.size("alts"), "alts") | F.exists("alts", lambda a: over(F.length(a), "text")), "alts")
               .when(over(F.size("media"), "media"), "media")
               .when(over(F.size("links"), "links") | bad_link, "links"))
    whole = (F.col("text_complete") & ~text.is_blank("text")
             & ~F.exists("links", lambda l: l["target"].isNull()))
    ids = j.groupBy("thread", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("thread").agg(
        F.min("id").alias("twice"))
    sums = j.withColumn("problem", problem).groupBy("thread").agg(
        F.count(F.lit(1)).alias("posts"), F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("pos"))).alias("problem"),
        F.bool_or(F.col("id") == F.col("clicked")).alias("has_clicked"), F.bool_and(whole).alias("whole"))
    out = t.join(sums, "thread", "left").join(ids, "thread", "left")
    refused = (F.when(~F.col("place").isin("status", "timeline"), F.concat(F.lit("where: "), "place"))
               .when(over(F.col("posts"), "posts"), f"posts: more than {limits.get('posts')}")
               .when(F.col("problem").isNotNull(), F.col("problem"))
               .when(F.col("twice").isNotNull(), F.concat(F.lit("posts: "), "twice", F.lit(" twice")))
               .when(~F.col("has_clicked"), "posts: the bookmarked post is not among them"))
    known = F.array_intersect("reasons", F.array(*[F.lit(r) for r in REASONS]))
    complete = (F.col("complete") & (F.col("place") == "status") & F.coalesce("whole", F.lit(True)) & (F.size(known) == 0))
    return out.select("thread", F.coalesce("posts", F.lit(0)).alias("posts"), refused.alias("refused"),
                      F.when(refused.isNull(), complete).alias("complete"))


def _byline(p) -> Column:
    name = F.when(F.coalesce(p["name"], F.lit("")) != "", F.concat(p["name"], F.lit(" (@"), p["handle"], F.lit(")")))
    who = F.coalesce(name, F.concat(F.lit("@"), p["handle"]), F.lit("Someone"))
    return F.concat_ws(", ", who, p["at"])


def _part(value: Column) -> Column:
    trimmed = F.regexp_replace(value, r"^\s+|\s+$", "")
    return F.when(trimmed != "", trimmed)


def post_section(p: Column) -> Column:
    """One post as markdown: byline, text, article, image descriptions, and its quote as a block quote."""
    body = F.concat_ws("\n\n", _byline(p), _part(p["text"]), _part(F.array_join(p["article_parts"], "\n\n")),
                       _part(F.array_join(F.transform(p["alts"], lambda a: F.concat(F.lit("Image: "), a)), "\n\n")))
    quoted = F.concat_ws("\n\n", F.concat(F.lit("Quoting @"), p["quote_handle"]), _part(p["quote_text"]))
    as_quote = F.array_join(F.transform(F.split(quoted, "\n"), lambda l: F.when(l == "", ">").otherwise(
        F.concat(F.lit("> "), l))), "\n")
    lone = F.concat(F.upper(F.substring(p["unavailable"], 1, 1)), F.substr(p["unavailable"], F.lit(2)), F.lit("."))
    return (F.when(p["unavailable"].isNotNull(), lone)
            .otherwise(F.concat_ws("\n\n", body, F.when(p["quote_handle"].isNotNull(), as_quote))))


def thread_text(posts: DataFrame) -> DataFrame:
    """One document per thread, posts in order divided by a rule.

    `posts` has (thread, pos, name, handle, at, text, article_title, article_parts,
    alts, quote_handle, quote_text, unavailable). A checked thread holds at most
    fifty posts (`check_threads`), which bounds the list.
    """
    p = posts.withColumn("p", F.struct(*[c for c in posts.columns]))
    has_text = ~text.is_blank("text") & F.col("unavailable").isNull()
    article = F.regexp_replace(F.col("p.article_title"), r"^\s+|\s+$", "")
    name = F.regexp_replace(_byline(F.col("p").withField("at", F.lit(None).cast("string"))), r", $", "")
    title = F.when(F.coalesce(article, F.lit("")) != "", article).otherwise(F.concat(name, F.lit(" on X")))
    g = p.select("thread", "pos", title.alias("title"), post_section(F.col("p")).alias("section"), has_text.alias("has_text")) \
        .groupBy("thread").agg(
        F.min_by("title", "pos").alias("title"), F.count(F.lit(1)).alias("posts"), F.bool_or("has_text").alias("any_text"),
        F.array_sort(F.collect_list(F.struct("pos", "section"))).alias("s"))
    joined = F.array_join(F.transform("s", lambda x: x["section"]), "\n\n---\n\n")
    return g.select("thread", "title", "posts", F.when(F.col("any_text"), "ok").otherwise("thin").alias("status"),
                    F.concat(F.lit("# "), "title", F.lit("\n\n"), F.regexp_replace(joined, r"\s+$", ""), F.lit("\n"))
                    .alias("markdown"))
