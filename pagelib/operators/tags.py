"""Tag decisions, vocabulary and suggestions: tables of requests in, new state out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagelib.functions import ordered, text, urls
from pagelib.functions.ordered import Coarse

MIN_POSITIVES = 10


def active_vocabulary(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.where(F.col("retired_at").isNull())


def spellings(vocabulary: DataFrame, retired: bool = False) -> DataFrame:
    """(fold, spelling) of the active names, or of all."""
    v = vocabulary if retired else active_vocabulary(vocabulary)
    return v.select(text.fold_tag("name").alias("fold"), F.col("name").alias("spelling"))


def _side(page_tags: DataFrame, side: str) -> DataFrame:
    return page_tags.where(F.col("side") == side).select("url", text.fold_tag("name").alias("fold")).distinct()


def shown_tags(page_tags: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(url, tag) a page shows: added names in the active vocabulary's spelling."""
    return _side(page_tags, "add").join(spellings(vocabulary), "fold").select("url", F.col("spelling").alias("tag"))


def tag_counts(page_tags: DataFrame, known: DataFrame, forgotten: DataFrame, vocabulary: DataFrame,
               retired: bool = False) -> DataFrame:
    held = (_side(page_tags, "add").join(known.select("url").distinct(), "url", "left_semi")
            .join(forgotten.select("url").distinct(), "url", "left_anti"))
    counts = held.groupBy("fold").agg(F.count(F.lit(1)).alias("pages"))
    return (spellings(vocabulary, retired).join(counts, "fold", "left")
            .select(F.col("spelling").alias("tag"), F.coalesce("pages", F.lit(0)).alias("pages")))


def tag_info(page_tags: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Positives of every active tag, and whether a head can be fitted on them."""
    counts = _side(page_tags, "add").groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return spellings(vocabulary).join(counts, "fold", "left").select(
        F.col("spelling").alias("tag"), n.alias("positives"),
        F.when(n >= MIN_POSITIVES, "head").otherwise("zero shot").alias("source"))


def decided_sides(page_tags: DataFrame) -> DataFrame:
    """Names that are both added and dismissed on a page; empty in a sound state."""
    return _side(page_tags, "add").intersect(_side(page_tags, "remove"))


def answered(suggested: DataFrame) -> DataFrame:
    return suggested.select("url").distinct()


def latest_answers(suggested: DataFrame) -> DataFrame:
    """The newest answer of each source on each page; sources match without case."""
    return (suggested.groupBy("url", F.lower("source").alias("source_fold"))
            .agg(F.max_by(F.struct("tags", "source", "vocabulary_version"), "seq").alias("r"))
            .select("url", "source_fold", "r.*"))


def undecided_suggestions(suggested: DataFrame, page_tags: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(url, fold, spelling, source) suggested, active, and neither added nor removed."""
    offered = latest_answers(suggested).select(
        "url", F.explode(F.array_distinct(F.transform("tags", lambda t: F.lower(t)))).alias("fold"), "source")
    decided = page_tags.select("url", text.fold_tag("name").alias("fold")).distinct()
    return offered.join(spellings(vocabulary), "fold").join(decided, ["url", "fold"], "left_anti")


def suggestion_view(suggested: DataFrame, page_tags: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Each suggested tag with the sources that agree on it, in tag order."""
    pairs = undecided_suggestions(suggested, page_tags, vocabulary)
    sources = F.array_sort(F.collect_set(F.struct(F.lower("source").alias("low"), "source")))
    return (pairs.groupBy("url", F.col("spelling").alias("tag")).agg(sources.alias("s"))
            .select("url", "tag", F.array_join(F.transform("s", lambda x: x["source"]), ", ").alias("sources"),
                    (F.size("s") >= 2).alias("agreed")))


def prompt_due(pages: DataFrame, page_tags: DataFrame, vocabulary: DataFrame, suggested: DataFrame,
               everything: bool = False) -> DataFrame:
    """Each listed page with why it is left out of the tagging worklist, NULL when due."""
    tagged = shown_tags(page_tags, vocabulary).select("url").distinct().withColumn("tagged", F.lit(True))
    out = pages.join(tagged, "url", "left").join(
        answered(suggested).withColumn("answered", F.lit(True)), "url", "left")
    why = F.when(F.col("tagged"), "tagged").when(F.col("answered"), "suggested")
    return out.withColumn("skipped", F.lit(None).cast("string") if everything else why).drop("tagged", "answered")


def prompt_coverage(prompted: DataFrame, answers: DataFrame) -> DataFrame:
    return prompted.select("url").distinct().join(answers.select("url"), "url", "left_anti")


def untagged(pages: DataFrame, shown: DataFrame, tag: str | None = None) -> DataFrame:
    """Pages with no tag, or without the given one; `shown` has (url, tag)."""
    held = shown if tag is None else shown.where(F.lower("tag") == tag.lower())
    return pages.join(held.select("url").distinct(), "url", "left_anti")


def vocabulary_version(vocabulary: DataFrame) -> DataFrame:
    """Twelve hex digits over the active names and definitions in tag order.

    The digest is of one text, so the vocabulary (one short row per tag name) is
    brought together; no page data is.
    """
    entry = F.struct(F.lower("name").alias("low"), "name", F.coalesce("definition", F.lit("")).alias("d"))
    ordered_names = F.array_sort(F.collect_list(entry))
    rows = F.transform(ordered_names, lambda e: F.array(e["name"], e["d"]))
    return active_vocabulary(vocabulary).agg(
        F.substring(F.sha2(F.to_json(rows), 256), 1, 12).alias("version"))


def recent_tags(vocabulary: DataFrame) -> DataFrame:
    return (active_vocabulary(vocabulary).where(F.col("used_at").isNotNull()).select("name", "used_at")
            .orderBy(F.desc("used_at"), F.lower("name"), "name"))


def apply_tags(requests: DataFrame, page_tags: DataFrame, vocabulary: DataFrame, known: DataFrame,
               now: Column) -> dict[str, DataFrame]:
    """Applies requests (url, name, action ∈ add/remove/clear, seq); the last per page and name holds.

    Names are stored with single spaces; an empty, long or control-character name is
    refused, with the problem as its outcome. Adding creates an unknown name and revives a
    retired one; removing or clearing an unknown name does nothing. Returns the new
    `page_tags` and `vocabulary`, and an `outcome` per request that holds, with the side
    before.
    """
    read = requests.withColumn("stored", text.normalize_tag("name"))
    none = F.lit(None).cast("string")
    refused = read.where(F.col("stored.problem").isNotNull()).groupBy("url", text.fold_tag("name").alias("fold")).agg(
        F.max_by("action", "seq").alias("action"), F.min("stored.problem").alias("problem")).select(
        "url", "fold", none.alias("spelling"), "action", none.alias("before"), none.alias("after"), F.col("problem").alias("outcome"))
    requests = read.where(F.col("stored.problem").isNull()).withColumn("name", F.col("stored.name")).drop("stored")
    last = (requests.withColumn("fold", text.fold_tag("name")).groupBy("url", "fold")
            .agg(F.max_by(F.struct("action", "name"), "seq").alias("r"), F.min("seq").alias("first_seq"))
            .select("url", "fold", "r.action", "r.name", "first_seq"))
    here = known.select("url").distinct().withColumn("known", F.lit(True))
    last = last.join(here, "url", "left")
    terms = vocabulary.select(text.fold_tag("name").alias("fold"), F.col("name").alias("spelling"), "retired_at")
    added = (last.where(F.col("known") & (F.col("action") == "add")).groupBy("fold")
             .agg(F.min_by("name", F.struct("first_seq", "url")).alias("typed")))
    admitted = terms.join(added, "fold", "full_outer").select(
        "fold", F.coalesce("spelling", "typed").alias("spelling"),
        F.col("spelling").isNull().alias("created"),
        (F.col("retired_at").isNotNull() & F.col("typed").isNotNull()).alias("revived"))
    before = page_tags.select("url", text.fold_tag("name").alias("fold"), F.col("side").alias("before"))
    asked = last.join(admitted, "fold", "left").join(before, ["url", "fold"], "left")
    after = F.when(F.col("action") == "add", "add").when(F.col("action") == "remove", "remove")
    effective = F.col("known") & F.col("spelling").isNotNull()
    outcome = asked.select(
        "url", "fold", "spelling", "action", "before",
        F.when(effective, after).otherwise(F.col("before")).alias("after"),
        F.when(F.col("known").isNull(), "unknown page").when(F.col("spelling").isNull(), "unknown name")
        .when(F.col("before").eqNullSafe(after), "unchanged").otherwise("changed").alias("outcome"))
    touched = outcome.where(F.col("outcome").isin("changed", "unchanged"))
    untouched = (page_tags.withColumn("fold", text.fold_tag("name"))
                 .join(touched.select("url", "fold"), ["url", "fold"], "left_anti").select("url", "name", "side"))
    decided = touched.where(F.col("after").isNotNull()).select(
        "url", F.col("spelling").alias("name"), F.col("after").alias("side"))
    landed = (outcome.where((F.col("outcome") == "changed") & (F.col("action") == "add"))
              .select("fold").distinct().withColumn("used", F.lit(True)))
    v = (vocabulary.withColumn("fold", text.fold_tag("name"))
         .join(admitted.withColumnRenamed("spelling", "name2"), "fold", "full_outer")
         .join(landed, "fold", "left"))
    new_vocabulary = v.select(
        F.coalesce("name", "name2").alias("name"), F.coalesce("created_at", now).alias("created_at"),
        F.when(~F.coalesce("revived", F.lit(False)), F.col("retired_at")).alias("retired_at"), "definition",
        F.when(F.col("used"), now).otherwise(F.col("used_at")).alias("used_at"))
    return {"page_tags": untouched.unionByName(decided), "vocabulary": new_vocabulary, "outcome": outcome.unionByName(refused)}


def undo_tags(undo: DataFrame, page_tags: DataFrame, vocabulary: DataFrame, known: DataFrame) -> DataFrame:
    """The state with just the touched decisions put back; `undo` has (url, fold, before)."""
    valid = (undo.select("url", "fold", "before").distinct().join(known.select("url").distinct(), "url", "left_semi")
             .join(spellings(vocabulary, retired=True), "fold"))
    rest = (page_tags.withColumn("fold", text.fold_tag("name"))
            .join(valid.select("url", "fold"), ["url", "fold"], "left_anti").select("url", "name", "side"))
    back = valid.where(F.col("before").isNotNull()).select("url", F.col("spelling").alias("name"),
                                                         F.col("before").alias("side"))
    return rest.unionByName(back)


def edit_vocabulary(edits: DataFrame, vocabulary: DataFrame, now: Column) -> dict[str, DataFrame]:
    """One batch of edits (name, action ∈ create/retire/define, definition, seq).

    Names are stored with single spaces. `problems` lists names that cannot be stored,
    names asked both to come and to go, and retired names the vocabulary lacks; the new
    vocabulary and outcomes ignore the last.
    """
    read = edits.withColumn("stored", text.normalize_tag("name"))
    refused = read.where(F.col("stored.problem").isNotNull()).select("name", F.col("stored.problem").alias("problem")).distinct()
    edits = read.where(F.col("stored.problem").isNull()).withColumn("name", F.col("stored.name")).drop("stored")
    e = edits.withColumn("fold", text.fold_tag("name")).groupBy("fold").agg(
        F.bool_or(F.col("action").isin("create", "define")).alias("comes"),
        F.bool_or(F.col("action") == "retire").alias("goes"),
        F.bool_or(F.col("action") == "define").alias("defines"),
        F.max_by(F.when(F.col("action") == "define", F.struct("definition")),
                 F.when(F.col("action") == "define", F.col("seq"))).alias("d"),
        F.min_by("name", "seq").alias("typed"))
    j = vocabulary.withColumn("fold", text.fold_tag("name")).join(e, "fold", "full_outer")
    exists = F.col("name").isNotNull()
    both = F.coalesce(F.col("comes") & F.col("goes"), F.lit(False))
    problems = j.where(both | (F.col("goes") & ~exists)).select(
        F.coalesce("name", "typed").alias("name"),
        F.when(both, "named both to keep and to retire").otherwise("unknown tag").alias("problem"))
    come = F.coalesce(F.col("comes"), F.lit(False)) & ~both
    go = F.coalesce(F.col("goes"), F.lit(False)) & ~both
    new_definition = F.when(come & F.col("defines"), F.col("d.definition")).otherwise(F.col("definition"))
    changed = F.concat_ws(
        ",", F.when(come & ~exists, "created"), F.when(come & exists & F.col("retired_at").isNotNull(), "revived"),
        F.when(go & exists & F.col("retired_at").isNull(), "retired"),
        F.when(~F.col("definition").eqNullSafe(new_definition), "defined"))
    merged = j.where(exists | come).select(
        F.coalesce("name", "typed").alias("name"), F.coalesce("created_at", now).alias("created_at"),
        F.when(come, F.lit(None)).when(go, F.coalesce("retired_at", now)).otherwise(F.col("retired_at"))
        .alias("retired_at"), new_definition.alias("definition"), "used_at", changed.alias("changed"))
    return {"vocabulary": merged.drop("changed"), "problems": problems.unionByName(refused),
            "outcome": merged.where(F.col("changed") != "").select("name", "changed")}


def forget_restore(requests: DataFrame, forgotten: DataFrame, known: DataFrame) -> dict[str, DataFrame]:
    """Applies (url, action ∈ forget/restore, seq); the last per page holds."""
    last = requests.groupBy("url").agg(F.max_by("action", "seq").alias("action"))
    mark = lambda df, name: df.select("url").distinct().withColumn(name, F.lit(True))
    j = (last.join(mark(known, "known"), "url", "left").join(mark(forgotten, "was"), "url", "left"))
    is_forget = F.col("action") == "forget"
    was = F.coalesce("was", F.lit(False))
    ok = F.coalesce("known", F.lit(False)) | (~is_forget & was)
    outcome = j.select("url", "action", F.when(~ok, "unknown").when(was == is_forget, "unchanged")
                       .otherwise("changed").alias("outcome"))
    changed = outcome.where(F.col("outcome") == "changed")
    kept = forgotten.select("url").distinct().join(
        changed.where(F.col("action") == "restore").select("url"), "url", "left_anti")
    new = changed.where(F.col("action") == "forget").select("url")
    return {"forgotten": kept.unionByName(new), "outcome": outcome}


def import_suggestions(answers: DataFrame, suggested: DataFrame, vocabulary: DataFrame, known: DataFrame,
                       prompted: DataFrame | None = None, accept_new: bool = False, partial: bool = False,
                       version: Column | None = None) -> dict[str, DataFrame]:
    """Checks a whole batch (line, url, tags, source) and gives the lines to store.

    Any problem refuses the batch: `lines` is then empty. A line is new when its
    folded tags or the vocabulary version differ from its source's latest.
    """
    a = answers.withColumn("source_fold", F.lower(text.collapse("source")))
    names = a.select("line", "url", F.explode("tags").alias("raw")).withColumn("n", text.normalize_tag("raw"))
    active = spellings(vocabulary)
    first = a.groupBy("url").agg(F.min("line").alias("first"))
    repeated = a.join(first, "url").where(F.col("line") > F.col("first")).select("line", F.lit("repeated page").alias("problem"))
    missing = a.join(known.select("url").distinct(), "url", "left_anti").select("line", F.lit("not in the library").alias("problem"))
    unsourced = a.where(F.coalesce("source_fold", F.lit("")) == "").select("line", F.lit("no source").alias("problem"))
    main = a.where(F.col("source_fold") != "").agg(F.min_by("source_fold", "line")).scalar()
    mixed = a.where((F.col("source_fold") != "") & (F.col("source_fold") != main)).select(
        "line", F.lit("another source").alias("problem"))
    bad = names.where(F.col("n.problem").isNotNull()).select("line", F.concat(F.lit("bad tag: "), "n.problem").alias("problem"))
    named = names.where(F.col("n.problem").isNull()).select("line", "url", F.col("n.name").alias("name"),
                                                          F.lower("n.name").alias("fold"))
    problems = repeated.union(missing).union(unsourced).union(mixed).union(bad)
    new_names = named.join(active, "fold", "left_anti")
    if not accept_new:
        problems = problems.union(new_names.select("line", F.lit("no such tag").alias("problem")))
    if prompted is not None and not partial:
        problems = problems.union(prompt_coverage(prompted, answers).select(
            F.lit(0).cast("long").alias("line"), F.lit("page without a line").alias("problem")))
    problem_count = problems.agg(F.count(F.lit(1))).scalar()
    created = new_names.groupBy("fold").agg(F.min_by("name", "line").alias("created"))
    # A page answered with no usable tag still counts as answered.
    folded = (a.select("line", "url", "source", "source_fold")
              .join(named.groupBy("line").agg(F.array_sort(F.collect_set("fold")).alias("folds")), "line", "left")
              .withColumn("folds", F.coalesce("folds", F.array().cast("array<string>"))))
    v = version if version is not None else vocabulary_version(vocabulary).select("version").scalar()
    stored = latest_answers(suggested).select(
        "url", "source_fold", F.array_sort(F.array_distinct(F.transform("tags", lambda t: F.lower(t)))).alias("folds"),
        F.col("vocabulary_version").alias("version"))
    lines = (folded.withColumn("version", v)
             .join(stored, ["url", "source_fold", "folds", "version"], "left_anti").where(problem_count == 0))
    return {"problems": problems, "lines": lines, "created": created}


def exclude_results(state: DataFrame, shown: DataFrame, actions: DataFrame) -> dict[str, DataFrame]:
    """Marks results not relevant, one action per query.

    `state` has (query, url, rank, cause ∈ click/cut), `shown` (query, url, rank),
    `actions` (query, action ∈ exclude/include/cut/uncut, url). A cut excludes all
    below it and replaces an earlier cut. The cuts with what each has seen are
    returned too.
    """
    at = actions.join(shown.select("query", "url", F.col("rank").alias("at")), ["query", "url"], "left").select(
        "query", "action", F.col("url").alias("target"), "at")
    marked = state.join(at, "query", "left")
    dropped = ((F.col("action") == "include") & (F.col("url") == F.col("target"))
               | (F.col("action").isin("cut", "uncut") & (F.col("cause") == "cut")))
    kept = marked.where(~F.coalesce(dropped, F.lit(False))).select("query", "url", "rank", "cause")
    fresh = shown.join(at, "query").where(
        ((F.col("action") == "exclude") & (F.col("url") == F.col("target")))
        | ((F.col("action") == "cut") & (F.col("rank") > F.col("at")))).select(
        "query", "url", "rank", F.when(F.col("action") == "cut", "cut").otherwise("click").alias("cause"))
    fresh = fresh.join(kept.select("query", "url"), ["query", "url"], "left_anti")
    cuts = at.where(F.col("action") == "cut").select("query", "target")
    return {"excluded": kept.unionByName(fresh), "cuts": cuts,
            "seen": shown.join(cuts, "query", "left_semi").select("query", "url")}


def cover_new_results(excluded: DataFrame, cuts: DataFrame, seen: DataFrame, shown: DataFrame) -> DataFrame:
    """Excludes results that first appear below a cut; those seen before stay as they were."""
    at = shown.join(cuts.withColumnRenamed("target", "url"), ["query", "url"]).select("query", F.col("rank").alias("at"))
    new = (shown.join(at, "query").where(F.col("rank") > F.col("at"))
           .join(seen.select("query", "url"), ["query", "url"], "left_anti")
           .join(excluded.select("query", "url"), ["query", "url"], "left_anti")
           .select("query", "url", "rank", F.lit("cut").alias("cause")))
    return excluded.unionByName(new)


def add_pages(requests: DataFrame, known: DataFrame, forgotten: DataFrame) -> DataFrame:
    """What becomes of each request (id, url, title): refused, known, forgotten or added, and the key.

    The address itself counts first, then its cleaned key, then any page whose
    own cleaned key matches, a visible one before a forgotten one.
    """
    from pagelib.operators.logs import refusal

    r = requests.withColumns({"reason": refusal("url"), "key": urls.clean_key("url")})
    state = (known.select("url", F.lit(True).alias("known"), F.lit(None).cast("boolean").alias("gone"))
             .unionByName(forgotten.select("url", F.lit(None).cast("boolean").alias("known"), F.lit(True).alias("gone")))
             .groupBy("url").agg(F.coalesce(F.bool_or("gone"), F.lit(False)).alias("gone")))
    exact = state.select(F.col("url"), F.when(F.col("gone"), "forgotten").otherwise("known").alias("as_is"))
    by_key = exact.select(F.col("url").alias("key"), F.col("as_is").alias("as_key"))
    variants = state.groupBy(urls.clean_key("url").alias("key")).agg(
        F.min(F.struct("gone", "url")).alias("variant"))
    j = r.join(exact, "url", "left").join(by_key, "key", "left").join(variants, "key", "left")
    outcome = (F.when(F.col("reason").isNotNull(), "refused")
               .when(F.col("as_is").isNotNull(), F.col("as_is"))
               .when(F.col("as_key").isNotNull(), F.col("as_key"))
               .when(F.col("variant").isNotNull(), F.when(F.col("variant.gone"), "forgotten").otherwise("known"))
               .otherwise("added"))
    held = (F.when(F.col("reason").isNotNull(), F.lit(None))
            .when(F.col("as_is").isNotNull(), F.col("url")).when(F.col("as_key").isNotNull(), F.col("key"))
            .when(F.col("variant").isNotNull(), F.col("variant.url")).otherwise(F.col("key")))
    return j.select("id", "url", outcome.alias("outcome"), held.alias("held"), "reason",
                    F.when(~text.is_blank("title"), F.col("title")).alias("title"))
