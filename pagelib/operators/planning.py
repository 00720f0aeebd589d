"""Fetch planning: what to fetch, in what order, once per document, spread over hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagelib.functions import ordered, urls
from pagelib.functions.ordered import Coarse
from pagelib.operators.library import forgotten_variants, listed_groups, snapshot_order

MIN_SIDE = 200
MAX_ASPECT = 3
SITE_DEFAULT = 3
NOT_RENDERED = "not rendered: HTTP 403"
# Request hosts, lanes and least seconds of the routes that are not the page's own.
ROUTE_HOSTS = {"x": "api.fxtwitter.com", "github": "api.github.com", "youtube": "www.youtube.com"}
CODE_HOST_LANES = 4
VIDEO_SECONDS = 2
# Rungs of the image ladder.
RUNGS = {"page_itself": 0, "x_media": 1, "youtube_thumbnail": 1, "github_social": 1, "github_readme": 1,
         "github_card": 1, "og_image": 2, "twitter_image": 2, "jsonld_image": 2, "itemprop_image": 2}
PLAN_ORDER = ["day", "place"]


def plan_keys() -> list[Column]:
    """Sort keys of plan order: newest sighting first, then layout order."""
    return [F.desc("seen.captured_at"), F.desc("seen.base"), F.desc("seen.ordinal"), F.asc("seen.window"),
            F.asc("seen.position"), F.asc("url")]


def numbered(plan: DataFrame, keys: list[str] = (), name: str = "place") -> DataFrame:
    """Plan places 1..n, in all or per key, without sorting the plan in one task.

    A bucket is one window of one snapshot, and of a large window 1,024 positions: most pages were last seen in the
    newest snapshot.
    """
    coarse = [*[Coarse(F.col(f"seen.{c}"), descending=True) for c in ("captured_at", "base", "ordinal")],
              Coarse(F.col("seen.window")), Coarse(F.floor(F.col("seen.position") / 1024))]
    return ordered.row_number(plan, list(keys), plan_keys(), coarse, name)


def http_outcome(status: Column) -> Column:
    """Struct (outcome, passing) of an HTTP status; NULL for a success."""
    def said(outcome: str, passing: bool = False) -> Column:
        return F.struct(F.lit(outcome).alias("outcome"), F.lit(passing).alias("passing"))

    return (F.when(status.between(200, 299), F.lit(None)).when(status == 401, said("behind_login"))
            .when(status == 403, said("blocked")).when(status.isin(404, 410), said("not_found"))
            .when((status == 429) | status.between(502, 504), said("error", True)).otherwise(said("error")))


def recorded_state(latest: DataFrame) -> DataFrame:
    """How the planner sees each page's latest line: failed, outdated or final."""
    mime = F.regexp_extract("reason", r"^not HTML \((.*)\)$", 1)
    readable = mime.isin("application/pdf", "text/plain") | mime.startswith("image/")
    outdated = (F.col("status") == "not_html") & (F.col("tier") == "web") & readable
    return latest.withColumn("recorded", F.when(F.col("status") == "error", "failed").when(outdated, "outdated")
                             .otherwise("final"))


def escalates(latest: DataFrame) -> Column:
    """A browser may improve on the line: read over HTTP as thin, or drawn by scripts."""
    pdf = F.coalesce(F.col("extractor") == "pdf", F.lit(False)) if "extractor" in latest.columns else F.lit(False)
    shell = (F.col("status") == "empty_shell") & F.col("reason").isin("drawn by scripts", "needs JavaScript")
    return F.coalesce((F.col("tier") == "web") & ~pdf & ((F.col("status") == "thin") | shell), F.lit(False))


def eligible_signed_in() -> Column:
    refused = F.col("status").isin("behind_login", "paywalled", "blocked")
    unrendered = F.col("status").isin("thin", "empty_shell") & F.col("reason").endswith(NOT_RENDERED)
    public = F.col("tier").isin("web", "x", "github", "youtube", "headless")
    return F.coalesce(public & (refused | unrendered), F.lit(False))


def newest_sightings(tabs: DataFrame) -> DataFrame:
    """One row per listed page with its newest sighting's place in plan order."""
    base, ordinal = snapshot_order()
    at = F.struct(F.col("captured_at"), base.alias("base"), ordinal.alias("ordinal"),
                  (-F.col("window")).alias("window"), (-F.col("position")).alias("position"))
    newest = tabs.groupBy("url").agg(F.max(at).alias("s"), F.count(F.lit(1)).alias("n"))
    return listed_groups(newest, "n").select("url", F.struct("s.captured_at", "s.base", "s.ordinal", (-F.col("s.window")).alias("window"),
                                         (-F.col("s.position")).alias("position")).alias("seen"))


def fetch_plan(tabs: DataFrame, forgotten: DataFrame, recorded: DataFrame, refetch: bool = False) -> DataFrame:
    """Every listed page with what a run does about it.

    `recorded` has (url, recorded ∈ final/failed/outdated/render); a metadata run
    passes every page of its log as final. `outcome` is skip (with `reason`),
    already, or fetch (with `why` ∈ new/refetch/retry/login/render).
    """
    pages = newest_sightings(tabs)
    gone = forgotten.select("url").distinct().withColumn("gone", F.lit(True))
    j = pages.join(gone, "url", "left").join(recorded.select("url", "recorded"), "url", "left")
    j = j.withColumn("reason", urls.skip_reason("url", F.coalesce("gone", F.lit(False))))
    final = F.coalesce(F.col("recorded") == "final", F.lit(False))
    already = final & F.lit(not refetch)
    why = (F.when(urls.is_login_page("url"), "login").when(F.col("recorded").isNull(), "new")
           .when(F.col("recorded").isin("final", "outdated"), "refetch").when(F.col("recorded") == "failed", "retry")
           .otherwise("render"))
    outcome = F.when(F.col("reason").isNotNull(), "skip").when(already, "already").otherwise("fetch")
    return j.select("url", urls.host_of("url").alias("host"), "seen", "reason", outcome.alias("outcome"),
                    F.when(outcome == "fetch", why).alias("why"))


def content_plan(tabs: DataFrame, forgotten: DataFrame, latest: DataFrame, refetch: bool = False,
                 code_tool: bool = True, video_tool: bool = True, browser: bool = True) -> DataFrame:
    """`fetch_plan` with the text run's rules on top.

    `outcome` becomes fetch, render, unsent (a login screen), not a document,
    forgotten, waiting (videos without their tool), browser waiting, skip or already.
    """
    known = recorded_state(latest).withColumn("improvable", escalates(latest))
    known = forgotten_variants(known, forgotten)
    renders = (F.col("recorded") == "final") & F.lit(not refetch) & ~F.col("covered") & F.col("improvable")
    state = known.select("url", F.when(renders & F.lit(browser), "render").otherwise(F.col("recorded")).alias("recorded"),
                         (renders & F.lit(not browser)).alias("held_back"))
    plan = fetch_plan(tabs, forgotten, state, refetch).join(state.select("url", "held_back"), "url", "left")
    plan = forgotten_variants(plan, forgotten).withColumn("d", urls.document_of("url"))
    fetch = F.col("outcome") == "fetch"
    render = F.col("why") == "render"
    route = F.when(render, "web").otherwise(F.col("d.route"))
    on_the_web = (route == "github") & F.lit(not code_tool)
    outcome = (F.when(~fetch & F.coalesce("held_back", F.lit(False)) & (F.col("outcome") == "already"), "browser waiting")
               .when(~fetch, F.col("outcome")).when(F.col("covered"), "forgotten")
               .when(render, "render").when(F.col("d.route").isNull(), "not a document")
               .when((route == "youtube") & F.lit(not video_tool), "waiting")
               .when(F.col("why") == "login", "unsent").otherwise("fetch"))
    final_route = F.when(on_the_web, "web").otherwise(route)
    host = F.coalesce(*[F.when(final_route == r, F.lit(h)) for r, h in ROUTE_HOSTS.items()], F.col("host"))
    key = F.when(final_route == F.col("d.route"), F.col("d.key")).otherwise(urls.page_url("url"))
    return plan.select("url", host.alias("host"), "seen", "reason", "why", outcome.alias("outcome"),
                       final_route.alias("route"), key.alias("document_key"))


def one_fetch_per_document(plan: DataFrame) -> DataFrame:
    """Every planned address with the address its document is fetched at: the first in plan order.

    Only the first address per document is gathered; the others join back to it,
    so a document opened at any number of addresses is never one row.
    """
    at = F.struct((-F.unix_micros(F.col("seen.captured_at"))).alias("t"), F.col("seen.window"), F.col("seen.position"),
                  F.col("url"))
    first = plan.groupBy("document_key", "outcome").agg(F.min_by("url", at).alias("fetch_url"))
    return plan.join(first, ["document_key", "outcome"])


def schedule_by_host(fetches: DataFrame) -> DataFrame:
    """Queue of every fetch and its place there; busiest queues rank first.

    A host whose route allows several requests is spread over lanes in turn. Run
    it with `repartition("queue")`; queues are independent.
    """
    placed = numbered(fetches, ["host"], "host_place")
    lanes = F.when(F.col("route") == "github", CODE_HOST_LANES).otherwise(1)
    lane = F.when(lanes == 1, F.lit("")).otherwise(F.concat(F.lit(" "), (F.col("host_place") % lanes).cast("string")))
    placed = placed.withColumn("queue", F.concat("host", lane)).withColumn(
        "queue_place", F.when(lanes == 1, F.col("host_place")).otherwise(F.ceil(F.col("host_place") / lanes)))
    sizes = placed.groupBy("queue").agg(F.count(F.lit(1)).alias("queue_size"))
    return placed.join(sizes, "queue")


def skip_counts(plan: DataFrame) -> DataFrame:
    said = F.when(F.col("outcome") == "already", "already fetched").otherwise(F.col("reason"))
    return (plan.where(F.col("outcome").isin("skip", "already")).groupBy(said.alias("reason"))
            .agg(F.count(F.lit(1)).alias("pages")))


def busiest_host_seconds(fetches: DataFrame) -> DataFrame:
    """The least seconds a run takes: its busiest host, whose first paced request is free."""
    cost = F.when(F.col("route") == "github", 0).when(F.col("route") == "youtube", VIDEO_SECONDS).otherwise(1)
    paced = ~F.col("route").isin("github", "youtube")
    hosts = fetches.groupBy("host").agg(F.sum(cost).alias("seconds"), F.bool_or(paced).alias("paced"))
    left = F.greatest(F.col("seconds") - F.col("paced").cast("long"), F.lit(0))
    return hosts.agg(F.coalesce(F.max(left), F.lit(0)).alias("seconds"))


def image_retries(images: DataFrame, plan: DataFrame, after_text: DataFrame, forgotten: DataFrame) -> DataFrame:
    """Pages whose latest image line failed and that no text fetch of this run covers."""
    failed = images.where(F.col("status") == "error").join(
        plan.where((F.col("outcome") == "fetch") & (F.col("why") == "retry")).select("url", "seen"), "url")
    failed = failed.join(after_text.select("url").distinct(), "url", "left_anti")
    return forgotten_variants(failed, forgotten).where(~F.col("covered")).drop("covered")


def signed_in_eligible_plan(tabs: DataFrame, forgotten: DataFrame, latest: DataFrame) -> DataFrame:
    """What a signed in run does about each candidate page: render, personal app or forgotten."""
    state = latest.select("url", F.when(eligible_signed_in(), "render").otherwise("final").alias("recorded"))
    no_line = tabs.select("url").distinct().join(state, "url", "left_anti").withColumn("recorded", F.lit("final"))
    plan = fetch_plan(tabs, forgotten, state.unionByName(no_line)).where(F.col("outcome") == "fetch")
    plan = forgotten_variants(plan, forgotten)
    outcome = (F.when(F.col("covered"), "forgotten").when(urls.is_personal_app("url"), "personal app")
               .when(F.col("why") == "render", "render").otherwise("left"))
    return plan.withColumn("outcome", outcome).withColumn("document_key", urls.page_url("url")).drop("covered")


def image_misfit(width: Column, height: Column) -> Column:
    small = (width < MIN_SIDE) | (height < MIN_SIDE)
    return (F.when(small, "too small")
            .when(F.greatest(width, height) > F.least(width, height) * MAX_ASPECT, "out of proportion"))


def site_default_images(metadata: DataFrame) -> DataFrame:
    """(host, image) a site gives three or more of its pages; `metadata` has (url, status, og_image, twitter_image)."""
    named = metadata.where(F.col("status") == "ok").select(
        urls.site_host("url").alias("host"), "url", F.explode(F.array_compact(F.array("og_image", "twitter_image"))).alias("image"))
    return (named.groupBy("host", "image").agg(F.countDistinct("url").alias("pages"))
            .where(F.col("pages") >= SITE_DEFAULT))


def image_ladder(candidates: DataFrame, defaults: DataFrame, most: int | None = None) -> DataFrame:
    """The candidates of each page in the order they are tried, all of them or the first `most`.

    `candidates` has (page, url, source, pos). Each address counts once, at its
    best rung; a cut applies after whole-group ranking. Where several lines of a page give
    images of the same rung and place, the address decides.
    """
    rung = F.coalesce(*[F.when(F.col("source") == s, r) for s, r in RUNGS.items()], F.lit(3))
    c = candidates.withColumns({"rung": rung, "host": urls.site_host("page")})
    d = defaults.select("host", F.col("image").alias("url"), F.lit(True).alias("is_default"))
    c = c.join(d, ["host", "url"], "left").withColumn(
        "rung", F.when((F.col("rung") == 2) & F.coalesce("is_default", F.lit(False)), 4).otherwise(F.col("rung")))
    once = c.groupBy("page", "url").agg(F.min(F.struct("rung", "pos", "source")).alias("k"))
    from pyspark.sql import Window
    w = Window.partitionBy("page").orderBy("k.rung", "k.pos", "url")
    placed = once.withColumn("place", F.row_number().over(w))
    placed = placed if most is None else placed.where(F.col("place") <= most)
    return (placed
            .select("page", "url", F.col("k.rung").alias("rung"), "place"))


def prefer_metadata(metadata: DataFrame) -> DataFrame:
    return metadata.where(F.col("status") == "ok")


def pin_state(pins: DataFrame, trees: DataFrame, shelf: DataFrame) -> DataFrame:
    """State of every pinned document: fresh, stale or unresolved, with why.

    `pins` has (url, blob), `trees` (repo, path, blob) of the checkouts at hand and
    `shelf` (sha256) of the loose files at hand.
    """
    p = pins.withColumn("k", urls.parse_source_key("url"))
    repos = trees.select("repo").distinct().withColumn("has_repo", F.lit(True))
    files = trees.select("repo", "path", F.col("blob").alias("current"))
    j = (p.select("url", "blob", "k.repo", "k.path", "k.sha256").join(repos, "repo", "left")
         .join(files, ["repo", "path"], "left")
         .join(shelf.select("sha256").distinct().withColumn("on_shelf", F.lit(True)), "sha256", "left"))
    git, loose = F.col("repo").isNotNull(), F.col("sha256").isNotNull()
    why = (F.when(~git & ~loose, "not a source key")
           .when(loose & F.col("on_shelf").isNull(), "not on the shelf")
           .when(git & F.col("has_repo").isNull(), "no checkout of its repository in checkouts.json")
           .when(git & F.col("blob").isNull(), "its pin names no blob")
           .when(git & F.col("current").isNull(), "gone from HEAD since it was added")
           .when(git & (F.col("current") != F.col("blob")), "changed at HEAD since it was added"))
    state = (F.when(why.isNull(), "fresh")
             .when(why.isin("gone from HEAD since it was added", "changed at HEAD since it was added"), "stale")
             .otherwise("unresolved"))
    return j.select("url", state.alias("state"), why.alias("why"))


def read_text(keys: DataFrame, added: DataFrame, forgotten: DataFrame, content: DataFrame,
              pins: DataFrame) -> DataFrame:
    """One answer per asked key (pos, url): the text, or why there is none.

    `content` has (url, text); `pins` (url, state, why, text) of pinned documents. An
    address that stands there several times answers with its greatest text.
    """
    content = content.groupBy("url").agg(F.max("text").alias("text"))
    pins = pins.groupBy("url").agg(F.max(F.struct("text", "state", "why")).alias("r")).select("url", "r.*")
    mark = lambda df, n: df.select("url").distinct().withColumn(n, F.lit(True))
    j = (keys.join(mark(forgotten, "gone"), "url", "left").join(mark(added, "added"), "url", "left")
         .join(content.select("url", F.col("text").alias("kept")), "url", "left")
         .join(pins.select("url", "why", F.when(F.col("state") != "unresolved", F.col("text")).alias("pinned"),
                           F.lit(True).alias("has_pin")), "url", "left"))
    kind = urls.source_kind("url")
    text = F.when(kind == "web", F.col("kept")).otherwise(F.col("pinned"))
    refusal = (F.when(F.col("gone"), "it is forgotten; restore it first")
               .when(F.col("added").isNull(), "not a page you added; search lists them")
               .when(text.isNotNull(), F.lit(None)).when(kind == "web", "no text kept for it")
               .when(F.col("has_pin").isNull(), "no pin; add the file again")
               .otherwise(F.coalesce("why", F.lit("unreadable"))))
    return j.select("pos", "url", kind.alias("kind"), F.when(refusal.isNull(), text).alias("text"),
                    refusal.alias("refusal"))
