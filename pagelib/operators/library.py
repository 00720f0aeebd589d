"""The library: pages folded from snapshots of tabs, and the questions asked of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagelib.functions import ordered, text, urls
from pagelib.functions.ordered import Coarse
from pagelib.operators.digests import set_digest

INTAKE = "added"


def snapshot_order(snapshot_id: str = "snapshot_id") -> list[Column]:
    """Same-second ids `…Z`, `…Z-2`, `…Z-10` in the order they were written."""
    c = F.col(snapshot_id)
    suffix = F.regexp_extract(c, r"-(\d+)$", 1)
    named = c.rlike(r"Z(-\d+)?$")
    base = F.when(named, F.regexp_replace(c, r"-\d+$", "")).otherwise(c)
    ordinal = F.when(named & (suffix != ""), suffix.try_cast("int")).otherwise(1)
    return [base, ordinal]


def order_snapshots(snapshots: DataFrame) -> DataFrame:
    return snapshots.orderBy("captured_at", *snapshot_order("id"))


def renumber_positions(tabs: DataFrame) -> DataFrame:
    """Places tabs from zero in each window; tabs of unknown place come last."""
    unknown = F.col("position") < 0
    return ordered.row_number(
        tabs, ["snapshot_id", "window"], [unknown, F.col("position"), F.col("tab_id")],
        [Coarse(unknown), Coarse(F.when(unknown, ordered.id_bucket("tab_id"))
                                 .otherwise(ordered.id_bucket("position", 64)))],
        "place").withColumn("position", F.col("place") - 1).drop("place")


def listed(tabs: DataFrame) -> DataFrame:
    """Tabs a library lists, with their domain; files and this machine are left out."""
    return tabs.withColumn("domain", urls.domain_of("url")).where(F.col("domain").isNotNull())


def listed_groups(groups: DataFrame, count: str) -> DataFrame:
    """`listed` for rows aggregated by address.

    The rule reads only the address, so it runs once per address. Naming a count
    keeps the optimizer from moving it below the aggregation, to every sighting.
    """
    domain = F.when(F.col(count) > 0, urls.domain_of("url"))
    return groups.withColumn("domain", domain).where(F.col("domain").isNotNull())


def known_urls(tabs: DataFrame) -> DataFrame:
    return listed_groups(tabs.groupBy("url").agg(F.count(F.lit(1)).alias("n")), "n").select("url")


def history_candidates(tabs: DataFrame, forgotten: DataFrame) -> DataFrame:
    return (known_urls(tabs).where(urls.is_web("url")).join(forgotten.select("url"), "url", "left_anti"))


def newest_snapshot(tabs: DataFrame) -> Column:
    """Id of the newest snapshot that is not the intake's, as a scalar."""
    return (tabs.where(F.col("snapshot_id") != INTAKE)
            .agg(F.max_by("snapshot_id", F.struct("captured_at", *snapshot_order()))).scalar())


def _sighting(*fields: str) -> Column:
    return F.struct(F.col("captured_at"), *snapshot_order(), *[F.col(f) for f in fields])


def library_pages(tabs: DataFrame, forgotten: DataFrame | None = None, shape: str = "export") -> DataFrame:
    """One row per listed address.

    The fold is one aggregation by address. Distinct snapshots are counted per
    (address, snapshot) first, so one address in every tab still spreads out.
    """
    placed = renumber_positions(tabs)
    newest = newest_snapshot(tabs)
    if forgotten is not None:
        gone = forgotten.select("url").distinct()
        if shape == "serve":
            placed = placed.join(gone.withColumn("forgotten", F.lit(True)), "url", "left").withColumn(
                "forgotten", F.coalesce("forgotten", F.lit(False)))
        else:
            placed = placed.join(gone, "url", "left_anti")
    if "forgotten" not in placed.columns:
        placed = placed.withColumn("forgotten", F.lit(False))
    titled = ~text.is_blank("title")
    at = _sighting("window", "position")
    early = F.struct(F.col("captured_at"), *snapshot_order(), -F.col("window"), -F.col("position"))
    grouped = F.col("group").isNotNull()
    pages = placed.groupBy("url").agg(
        F.coalesce(F.max_by(F.when(titled, F.col("title")), F.when(titled, at)), F.lit("")).alias("title"),
        F.max("forgotten").alias("forgotten"),
        F.min("captured_at").alias("first_seen"),
        F.max("captured_at").alias("last_seen"),
        F.countDistinct("snapshot_id").alias("times_seen"),
        F.count(F.lit(1)).alias("sightings"),
        F.bool_or(F.col("snapshot_id") == newest).alias("open"),
        F.max_by(F.struct("snapshot_id", "window", "position"), at).alias("last"),
        F.min_by("snapshot_id", at).alias("first_snapshot"),
        F.max_by(F.when(grouped, F.struct("snapshot_id", "group")), F.when(grouped, early)).alias("sat"))
    return listed_groups(pages, "sightings").select(
        "url", "title", "domain", "forgotten", "first_seen", "last_seen", "times_seen", "sightings", "open",
        F.col("last.snapshot_id").alias("last_snapshot"), "first_snapshot",
        F.col("last.window").alias("last_window"), F.col("last.position").alias("last_position"),
        F.when(F.col("sat.snapshot_id") == F.col("last.snapshot_id"), F.col("sat.group")).alias("last_group"))


def sort_keys(by: str) -> list[Column]:
    """Order of the page list; every order ends with the address."""
    d = {"last": [F.desc("last_seen"), F.desc("last_snapshot"), F.asc("last_window"), F.asc("last_position")],
         "first": [F.desc("first_seen"), F.desc("first_snapshot"), F.asc("last_window"),
                   F.asc("last_position")],
         "count": [F.desc("times_seen"), F.desc("last_snapshot"), F.asc("last_window")],
         "title": [F.lower(text.sort_name("title", "url")), F.desc("last_snapshot")],
         "url": [F.asc("url")],
         "relevance": [F.asc_nulls_last("rank"), F.desc("last_seen"), F.desc("last_snapshot")]}
    return [*d[by], F.asc("url")]


def sort_pages(pages: DataFrame, by: str) -> DataFrame:
    return pages.orderBy(*sort_keys(by))


def place_pages(pages: DataFrame, by: str) -> DataFrame:
    """Every page with its place in one of the orders, numbered without one sorting task.

    Buckets follow the order as far as it takes to keep them small: one window of a snapshot, and of a large window 1,024
    positions; a long prefix of a title or an address. Pages without a rank are ordered by their last sighting.
    """
    down = lambda *names: [Coarse(F.col(c), descending=True) for c in names]
    spot = [Coarse(F.col("last_window")), Coarse(F.floor(F.col("last_position") / 1024))]
    coarse = {"last": [*down("last_seen", "last_snapshot"), *spot], "first": [*down("first_seen", "first_snapshot"), *spot],
              "count": [*down("times_seen", "last_snapshot"), Coarse(F.col("last_window")), Coarse(F.substring("url", 1, 48))],
              "title": [Coarse(F.substring(F.lower(text.sort_name("title", "url")), 1, 12))], "url": [Coarse(F.substring("url", 1, 48))]}
    if by == "relevance":
        unranked = F.col("rank").isNull()
        coarse[by] = [Coarse(F.when(unranked, 1 << 50).otherwise(F.floor(F.col("rank") / 1024))),
                      *[Coarse(F.when(unranked, F.col(c)), descending=True) for c in ("last_seen", "last_snapshot")],
                      Coarse(F.when(unranked, F.substring("url", 1, 48)))]
    return ordered.row_number(pages, [], sort_keys(by), coarse[by], "place")


def library_stats(tabs: DataFrame, forgotten: DataFrame) -> DataFrame:
    """Counts of an export: forgotten pages are counted, but not among the pages."""
    seen = listed_groups(tabs.groupBy("url").agg(F.count(F.lit(1)).alias("n")), "n")
    marked = seen.join(forgotten.select("url").distinct().withColumn("gone", F.lit(1)), "url", "left")
    kept = F.col("gone").isNull()
    snapshots = tabs.select("snapshot_id").distinct().agg(F.count(F.lit(1))).scalar()
    return marked.agg(
        F.count(F.when(kept, 1)).alias("pages"),
        F.countDistinct(F.when(kept, F.col("domain"))).alias("domains"),
        F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("sightings"),
        F.count(F.when(~kept, 1)).alias("forgotten")).withColumn("snapshots", snapshots)


def snapshot_list(tabs: DataFrame, stats: DataFrame) -> DataFrame:
    """Snapshots newest first with their sizes and whether the parse was clean."""
    sizes = listed(tabs).groupBy("snapshot_id").agg(
        F.max("captured_at").alias("captured_at"), F.count(F.lit(1)).alias("tabs"),
        F.countDistinct("window").alias("windows"), F.countDistinct("group").alias("groups"))
    return (sizes.join(snapshot_degraded(stats), "snapshot_id", "left")
            .orderBy(F.desc("captured_at"), F.desc("snapshot_id")))


def snapshot_degraded(stats: DataFrame) -> DataFrame:
    """Whether a parse was not clean, and the one-line account of it."""
    def part(column: str, words: str) -> Column:
        return F.when(F.col(column) > 0, F.concat(F.col(column).cast("string"), F.lit(words)))

    unknown = F.col("unknown_commands")
    ids = F.array_join(F.col("unknown_ids"), ", ") if "unknown_ids" in stats.columns else F.lit("")
    marker_ok = F.col("marker_count") == 1
    parts = [
        F.when(unknown > 0, F.concat(unknown.cast("string"), F.lit(" unknown commands (ids "), ids, F.lit(")"))),
        part("malformed_commands", " malformed commands"),
        part("truncated_bytes", " trailing bytes unparsed"),
        part("dropped_tabs", " tabs dropped"),
        part("navigation_fallbacks", " navigation fallbacks"),
        part("groups_without_metadata", " groups without metadata"),
        F.when(~marker_ok, F.concat(F.col("marker_count").cast("string"), F.lit(" state markers (expected 1)")))]
    return stats.select("snapshot_id", F.concat_ws(", ", *parts).alias("summary")).withColumn(
        "degraded", F.col("summary") != "")


def sighting_groups(tabs: DataFrame, groups: DataFrame) -> DataFrame:
    """Each tab with the group it sits in, in the same snapshot."""
    g = groups.select("snapshot_id", F.col("id").alias("group"),
                      F.coalesce("title", F.lit("")).alias("group_title"), F.col("colour").alias("group_colour"))
    return tabs.join(g, ["snapshot_id", "group"], "left")


def layout_digest(tabs: DataFrame) -> DataFrame:
    """One digest per snapshot of its arrangement; titles and times play no part."""
    return tabs.groupBy("snapshot_id").agg(set_digest(
        *[F.col(c) for c in ("window", "position", "url", "pinned", "group")]).alias("digest"))


def unchanged_snapshots(captures: DataFrame) -> DataFrame:
    """Marks captures equal to the one before them in the same browser and profile."""
    previous = ordered.lag(
        captures, ["browser", "profile"], [F.col("captured_at"), F.col("id")], ["captured_at", "id"],
        [Coarse(F.date_trunc("hour", "captured_at"))], "previous", F.col("digest"))
    return previous.withColumn("unchanged", F.coalesce(F.col("previous") == F.col("digest"), F.lit(False)))


def exclude_this_machine(tabs: DataFrame, windows: DataFrame, groups: DataFrame) -> dict[str, DataFrame]:
    """Snapshots as if tabs on this machine had never been open.

    Emptied windows go and the rest are renumbered, known positions close up,
    groups without tabs go, a removed active tab leaves its window without one.
    """
    local = urls.is_this_machine("url")
    touched = tabs.where(local).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("excluded_tabs"))
    kept = tabs.where(~local)
    left = kept.groupBy("snapshot_id", "window").agg(F.count(F.lit(1)).alias("left"))
    w = (windows.join(touched.select("snapshot_id", F.lit(True).alias("touched")), "snapshot_id", "left")
         .join(left.withColumnRenamed("window", "number"), ["snapshot_id", "number"], "left"))
    w = w.where(F.col("touched").isNull() | (F.col("tabs") == 0) | F.col("left").isNotNull())
    w = ordered.row_number(w, ["snapshot_id"], [F.col("number")],
                           [Coarse(ordered.id_bucket("number", 1024))], "order")
    w = w.withColumn("new_number", F.when(F.col("touched"), F.col("order")).otherwise(F.col("number")))
    active = kept.select("snapshot_id", F.col("tab_id").alias("active_tab"), F.lit(True).alias("here"))
    new_windows = (w.join(active, ["snapshot_id", "active_tab"], "left").select(
        "snapshot_id", F.col("new_number").alias("number"),
        F.coalesce("left", F.lit(0)).alias("tabs"),
        F.when(F.col("here"), F.col("active_tab")).alias("active_tab")))
    renumber = w.select("snapshot_id", F.col("number").alias("window"), "new_number", "touched")
    moved = kept.join(renumber, ["snapshot_id", "window"]).withColumn("window", F.col("new_number"))
    known = F.col("position") >= 0
    moved = ordered.row_number(
        moved.withColumn("known", known), ["snapshot_id", "window", "known"],
        [F.col("position"), F.col("tab_id")],
        [Coarse(F.when(known, ordered.id_bucket("position", 64)).otherwise(ordered.id_bucket("tab_id")))],
        "place")
    new_tabs = moved.withColumn(
        "position", F.when(F.col("touched") & known, F.col("place") - 1).otherwise(F.col("position"))
    ).drop("known", "place", "new_number", "touched")
    held = kept.select("snapshot_id", F.col("group").alias("id")).distinct()
    new_groups = (groups.join(touched.select("snapshot_id", F.lit(True).alias("touched")), "snapshot_id", "left")
                  .join(held.withColumn("held", F.lit(True)), ["snapshot_id", "id"], "left")
                  .where(F.col("touched").isNull() | F.col("held"))
                  .join(renumber.select("snapshot_id", "window", "new_number"), ["snapshot_id", "window"], "left")
                  .withColumn("window", F.coalesce("new_number", "window"))
                  .drop("new_number", "touched", "held"))
    count = lambda df, name: df.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias(name))
    stats = (tabs.select("snapshot_id").distinct()
             .join(count(new_windows, "windows"), "snapshot_id", "left")
             .join(count(kept, "tabs"), "snapshot_id", "left")
             .join(count(new_groups, "groups"), "snapshot_id", "left")
             .join(touched, "snapshot_id", "left").na.fill(0))
    return {"tabs": new_tabs, "windows": new_windows, "groups": new_groups, "stats": stats}


def intake_fold(added: DataFrame) -> DataFrame:
    """Added pages as one snapshot: placed by first line, titled by the latest."""
    pages = added.groupBy("url").agg(
        F.min("seq").alias("first_seq"), F.max_by("added_at", "seq").alias("added_at"),
        F.coalesce(F.max_by(F.struct("title"), F.col("seq"))["title"], F.lit("")).alias("title"))
    placed = ordered.row_number(pages, [], [F.col("first_seq")],
                                [Coarse(ordered.id_bucket("first_seq"))], "tab_id")
    started = added.agg(F.min("added_at")).scalar()
    return placed.select(
        F.lit(INTAKE).alias("snapshot_id"), started.alias("captured_at"), F.lit(1).cast("long").alias("window"),
        (F.col("tab_id") - 1).alias("position"), "tab_id", "url", "title", "added_at")


def with_intake(tabs: DataFrame, added: DataFrame) -> DataFrame:
    """Dated snapshots and the one intake snapshot together."""
    return tabs.unionByName(
        intake_fold(added).withColumns({"pinned": F.lit(False), "active": F.lit(False)}),
        allowMissingColumns=True)


def first_last_seen(tabs: DataFrame) -> DataFrame:
    """Earliest and latest sighting; an added page counts at its own added time."""
    at = F.when(F.col("snapshot_id") == INTAKE, F.coalesce("added_at", "captured_at")).otherwise(
        F.col("captured_at"))
    seen = tabs.groupBy("url").agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("n"))
    return listed_groups(seen, "n").select("url", "first_seen", "last_seen")


def snapshot_flow(pages: DataFrame) -> DataFrame:
    """Per snapshot: pages first seen there, and pages last seen there and not open."""
    fresh = pages.groupBy(F.col("first_snapshot").alias("snapshot_id")).agg(
        F.count(F.lit(1)).alias("fresh"), F.lit(0).cast("long").alias("gone"))
    gone = pages.where(~F.col("open")).groupBy(F.col("last_snapshot").alias("snapshot_id")).agg(
        F.lit(0).cast("long").alias("fresh"), F.count(F.lit(1)).alias("gone"))
    return fresh.unionByName(gone).groupBy("snapshot_id").agg(F.sum("fresh").alias("fresh"),
                                                            F.sum("gone").alias("gone"))


def sighting_strip(tabs: DataFrame, cells: int) -> DataFrame:
    """Share of each run of snapshots that held the page, `cells` runs in all."""
    snaps = tabs.groupBy("snapshot_id").agg(F.max("captured_at").alias("captured_at"))
    snaps = ordered.row_number(snaps, [], [F.col("captured_at"), *snapshot_order()],
                               [Coarse(F.date_trunc("month", "captured_at"))], "k")
    total = tabs.select("snapshot_id").distinct().agg(F.count(F.lit(1))).scalar()
    width = F.least(F.lit(cells).cast("long"), total)
    snaps = snaps.withColumn("cell", F.floor((F.col("k") - 1) * width / total))
    held = tabs.select("url", "snapshot_id").distinct()
    hits = held.join(snaps.select("snapshot_id", "cell"), "snapshot_id").groupBy("url", "cell").agg(
        F.count(F.lit(1)).alias("held"))
    capacity = snaps.groupBy("cell").agg(F.count(F.lit(1)).alias("of"))
    return listed_groups(hits, "held").join(capacity, "cell").select("url", "cell", (F.col("held") / F.col("of")).alias("share"))


def month_bands(pages: DataFrame, sort: str = "last") -> DataFrame:
    month = lambda c: F.date_format(c, "yyyy-MM")
    band = (F.when(F.col("open"), "Open now").otherwise(month("last_seen")) if sort == "last"
            else month("first_seen") if sort == "first" else F.lit(""))
    return pages.withColumn("band", band)


def newest_first(pages: DataFrame, added: str = "added_at") -> DataFrame:
    return pages.orderBy(F.desc_nulls_last(added), F.asc("url"))


def facet_filter(pages: DataFrame, q: str = "", domain: str = "", group: str = "", status: str = "all",
                 tags: list[str] = (), skip: str = "") -> DataFrame:
    """The page list's one predicate.

    `pages` carries groups (lower case titles) and tags (folded, own and
    suggested). Domain and group match exactly where that value exists in the
    library and else as a part. `skip` names a filter to leave out.
    """
    hay = F.lower(F.concat_ws(" ", "title", "url"))
    keep = F.col("forgotten") == F.lit(status == "forgotten")
    if domain.strip() and skip != "domain":
        d = domain.strip().lower()
        exact = pages.agg(F.coalesce(F.bool_or(F.col("domain") == d), F.lit(False))).scalar()
        keep = keep & F.when(exact, F.col("domain") == d).otherwise(F.col("domain").contains(d))
    if group.strip() and skip != "group":
        g = group.strip().lower()
        exact = pages.agg(F.coalesce(F.bool_or(F.array_contains("groups", g)), F.lit(False))).scalar()
        keep = keep & F.when(exact, F.array_contains("groups", g)).otherwise(
            F.exists("groups", lambda x: x.contains(g)))
    if status == "open":
        keep = keep & F.col("open")
    elif status == "closed":
        keep = keep & ~F.col("open")
    elif status == "suggested":
        keep = keep & F.col("has_suggested")
    for tag in tags:
        keep = keep & F.array_contains("tags", tag.lower())
    for word in q.lower().split():
        keep = keep & hay.contains(word)
    return pages.where(keep)


def facets(pages: DataFrame, by: str, **filters) -> DataFrame:
    """Pages per site or group among those the other filters leave."""
    left = facet_filter(pages, skip=by, **filters)
    values = (left.where(F.col("domain") != "").select(F.col("domain").alias("value")) if by == "domain"
              else left.select(F.explode(F.array_distinct("groups")).alias("value")))
    return values.groupBy("value").agg(F.count(F.lit(1)).alias("pages")).orderBy(F.desc("pages"), "value")


def tag_cooccurrence(pages: DataFrame) -> DataFrame:
    """Tag counts over the shown pages."""
    return pages.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("pages"))


def search_filter(pages: DataFrame, tags: list[str] = (), domains: list[str] = (), kinds: list[str] = (),
                  after=None, before=None) -> DataFrame:
    """AND across kinds of filter: every tag, any domain, any kind, added in [after, before)."""
    if after is not None and before is not None and after > before:
        raise ValueError("after is later than before")
    wanted = [t.lower() for t in tags]
    folded = F.transform("tags", lambda t: F.lower(t))
    keep = F.size(F.array_intersect(folded, F.array(*map(F.lit, wanted)))) == len(set(wanted)) if wanted else F.lit(True)
    kind = urls.source_kind("url")
    if domains:
        keep = keep & (kind == "web") & urls.domain_of("url").isin([d.lower() for d in domains])
    if kinds:
        keep = keep & kind.isin(list(kinds))
    if after is not None:
        keep = keep & (F.col("added_at") >= F.lit(after))
    if before is not None:
        keep = keep & (F.col("added_at") < F.lit(before))
    return pages.where(keep)


def limit_more(plan: DataFrame, n: int, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The first n in plan order, and a one-row count of how many were left."""
    more = plan.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("more"))
    return plan.orderBy(*order).limit(n), more


def export_privacy(pages: DataFrame, forgotten: DataFrame, with_history: bool) -> DataFrame:
    """Exports drop forgotten pages, and search and referrer unless asked.

    `pages` carries `search` and `referrer`; a forgotten page is never named as a
    referrer, whatever credentials either address holds.
    """
    gone = forgotten.select("url").distinct()
    kept = pages.join(gone, "url", "left_anti")
    if not with_history:
        return kept.withColumns({"search": F.lit(None).cast(kept.schema["search"].dataType),
                                 "referrer": F.lit(None).cast("string")})
    named = gone.select(urls.database_url("url").alias("gone_key")).distinct().withColumn("hide", F.lit(True))
    ref = urls.database_url("referrer")
    shown = kept.withColumn("ref_key", ref).join(named, F.col("ref_key") == F.col("gone_key"), "left")
    ok = (F.col("hide").isNull() & (F.col("ref_key") != urls.database_url("url"))
          & urls.domain_of("referrer").isNotNull())
    return shown.withColumn("referrer", F.when(ok, F.col("referrer"))).drop("ref_key", "gone_key", "hide")


def name_referrers(pages: DataFrame) -> DataFrame:
    """Adds the referrer's title where it is a page here with a title of its own.

    A referrer that is the page itself, or on this machine, is dropped.
    """
    titles = pages.where(~text.is_blank("title")).select(F.col("url").alias("referrer"),
                                                        F.col("title").alias("referrer_title"))
    ok = (urls.database_url("referrer") != urls.database_url("url")) & urls.domain_of("referrer").isNotNull()
    # Pages without a referrer are most of them and meet no title: they stay out of the join.
    pages = pages.withColumn("referrer", F.when(ok, F.col("referrer")))
    joined = pages.where("referrer is not null").join(titles, "referrer", "left")
    return joined.unionByName(pages.where("referrer is null"), allowMissingColumns=True)


def page_history(pages: DataFrame, recorded: DataFrame, carried: DataFrame) -> DataFrame:
    """Recorded signals of a page, else those of the newest snapshot that carried any.

    `carried` has (url, captured_at, signals); `recorded` has (url, signals).
    """
    newest = carried.where(F.col("signals").isNotNull()).groupBy("url").agg(
        F.max_by("signals", "captured_at").alias("carried"))
    known = recorded.select("url", F.col("signals").alias("recorded"))
    return (pages.join(known, "url", "left").join(newest, "url", "left")
            .withColumn("history", F.coalesce("recorded", "carried")).drop("recorded", "carried"))


def forgotten_variants(pages: DataFrame, forgotten: DataFrame) -> DataFrame:
    """Pages with `covered`: any fragment variant of a forgotten page counts as forgotten."""
    keys = forgotten.select(urls.page_url("url").alias("fetch_url")).distinct().withColumn("covered", F.lit(True))
    return (pages.withColumn("fetch_url", urls.page_url("url")).join(keys, "fetch_url", "left")
            .withColumn("covered", F.coalesce("covered", F.lit(False))).drop("fetch_url"))


def page_records(pages: DataFrame, shown: DataFrame, content: DataFrame, images: DataFrame,
                 metadata: DataFrame) -> DataFrame:
    """One row per known page for the models: title, host, tags and what is kept of it.

    `content` has the latest text line per url, `images` (url, status, kept) and
    `metadata` (url, lines). An address with several image or metadata lines counts
    once, so every join is one-to-one on the address.
    """
    tags = shown.groupBy("url").agg(F.count(F.lit(1)).alias("tags"))
    ok = lambda df, keep, name: df.where((F.col("status") == "ok") & keep).select("url", F.lit(True).alias(name)).distinct()
    texts = ok(content, F.col("content_sha256").isNotNull(), "text_ok")
    pictures = ok(images, F.col("kept"), "image_ok")
    out = (pages.join(tags, "url", "left").join(texts, "url", "left").join(pictures, "url", "left")
           .join(metadata.groupBy("url").agg(F.max("lines").alias("lines")), "url", "left"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return out.select(
        "url", F.col("domain").alias("host"), "title", "forgotten", F.coalesce("tags", F.lit(0)).alias("tags"),
        (F.coalesce("tags", F.lit(0)) > 0).alias("labelled"), yes("text_ok").alias("text_ok"), yes("image_ok").alias("image_ok"),
        F.col("lines").isNotNull().alias("has_metadata"), F.concat_ws("\n", urls.host_path("url"), "lines").alias("text"))


def dataset_summary(records: DataFrame, shown: DataFrame) -> DataFrame:
    n = lambda cond: F.count(F.when(cond, 1))
    lab, txt, img = F.col("labelled"), F.col("text_ok"), F.col("image_ok")
    trained = shown.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where("n >= 10").agg(F.count(F.lit(1))).scalar()
    return records.agg(
        F.count(F.lit(1)).alias("known_pages"), n(lab).alias("labelled_pages"), n(~lab).alias("unlabelled_pages"),
        F.sum("tags").alias("associations"), n(lab & txt).alias("labelled_text_ok"), n(lab & img).alias("labelled_image_ok"),
        n(lab & txt & img).alias("labelled_both_ok"), n(lab & F.col("has_metadata")).alias("labelled_with_metadata")
    ).withColumn("trained_tags", trained)
