"""Tag decisions, vocabulary and suggestions over tags made from documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelib.functions import text
from pagelib.operators import library as lib
from pagelib.operators import tags
from pagelib.plans.registry import query
from pagelib.plans.tables import SQL_VIEWS, Tables
from pagelib.plans.url_queries import DOMAIN, PRIVATE

def now():
    return F.timestamp_seconds(F.lit(1735689600))


SQL_VIEWS["active_names"] = "SELECT lower(name) AS fold, name FROM vocabulary WHERE retired_at IS NULL"
SQL_VIEWS["owned"] = "SELECT url, lower(name) AS fold, side FROM page_tags"
SQL_VIEWS["shown"] = "SELECT url, name AS tag FROM owned JOIN (SELECT fold, name FROM active_names) USING (fold) WHERE side = 'add'"


@query("tag_counts", """
SELECT v.name AS tag, count(o.url) AS pages FROM vocabulary v LEFT JOIN (SELECT * FROM owned WHERE side = 'add'
  AND url IN (SELECT url FROM sightings) AND url NOT IN (SELECT url FROM forgotten)) o ON o.fold = lower(v.name)
GROUP BY v.name""")
def _tag_counts(t):
    return tags.tag_counts(t.page_tags(), t.sightings(), t.forgotten(), t.vocabulary(), retired=True)


@query("tag_info", """
SELECT name AS tag, count(o.url) AS positives, CASE WHEN count(o.url) >= 10 THEN 'head' ELSE 'zero shot' END AS source
FROM active_names LEFT JOIN (SELECT * FROM owned WHERE side = 'add') o USING (fold) GROUP BY name""")
def _tag_info(t):
    return tags.tag_info(t.page_tags(), t.vocabulary())


@query("added_and_dismissed", """
SELECT (SELECT count(*) FROM owned WHERE side = 'add') AS added, (SELECT count(*) FROM owned WHERE side = 'remove')
  AS dismissed, (SELECT count(*) FROM owned a JOIN owned b USING (url, fold) WHERE a.side = 'add' AND b.side = 'remove') AS both""")
def _sides(t):
    p = t.page_tags()
    both = tags.decided_sides(p).agg(F.count(F.lit(1))).scalar()
    return p.agg(F.count(F.when(F.col("side") == "add", 1)).alias("added"),
                 F.count(F.when(F.col("side") == "remove", 1)).alias("dismissed")).withColumn("both", both)


@query("answered", "SELECT DISTINCT url FROM suggested")
def _answered(t):
    return tags.answered(t.suggested())


SQL_VIEWS["offered"] = """
SELECT DISTINCT url, lower(tag) AS fold, source FROM (SELECT url, source, unnest(tags) AS tag FROM (
  SELECT *, row_number() OVER (PARTITION BY url, lower(source) ORDER BY seq DESC) AS rn FROM suggested) WHERE rn = 1)"""
SQL_VIEWS["undecided"] = """
SELECT url, fold, name AS spelling, source FROM offered JOIN (SELECT fold, name FROM active_names) USING (fold)
WHERE NOT EXISTS (SELECT 1 FROM owned w WHERE w.url = offered.url AND w.fold = offered.fold)"""


@query("undecided_suggestions", "SELECT * FROM undecided")
def _undecided(t):
    return tags.undecided_suggestions(t.suggested(), t.page_tags(), t.vocabulary()).select("url", "fold", "spelling", "source")


@query("suggestion_view", """
SELECT url, spelling AS tag, string_agg(source, ', ' ORDER BY lower(source), source) AS sources, count(*) >= 2 AS agreed
FROM undecided GROUP BY url, spelling""")
def _view(t):
    return tags.suggestion_view(t.suggested(), t.page_tags(), t.vocabulary())


_SOME = "seq % 4 = 1 AND lower(source) = 'signup'"


@query("prompt_due", f"""
SELECT url, CASE WHEN url IN (SELECT url FROM shown) THEN 'tagged' WHEN url IN (SELECT url FROM suggested WHERE {_SOME})
  THEN 'suggested' END AS skipped FROM kept_pages""")
def _due(t):
    p = lib.library_pages(t.sightings(), t.forgotten())
    return tags.prompt_due(p, t.page_tags(), t.vocabulary(), t.suggested().where(_SOME)).select("url", "skipped")


@query("prompt_coverage", f"""
SELECT url FROM pages WHERE page_id % 2 = 0 AND url NOT IN (SELECT url FROM suggested WHERE {_SOME})""")
def _coverage(t):
    return tags.prompt_coverage(t.raw("pages").where("page_id % 2 = 0"), t.suggested().where(_SOME))


@query("untagged", """
SELECT url, url NOT IN (SELECT url FROM shown) AS without_any FROM kept_pages
WHERE url NOT IN (SELECT url FROM shown WHERE lower(tag) = 'toxic')""")
def _untagged(t):
    p = lib.library_pages(t.sightings(), t.forgotten())
    shown = tags.shown_tags(t.page_tags(), t.vocabulary())
    without = tags.untagged(p, shown).select("url", F.lit(True).alias("w"))
    return (tags.untagged(p, shown, "toxic").join(without, "url", "left")
            .select("url", F.coalesce("w", F.lit(False)).alias("without_any")))


@query("vocabulary_version", """
SELECT sha256('[' || string_agg('["' || name || '","' || coalesce(definition, '') || '"]', ',' ORDER BY lower(name), name)
  || ']')[1:12] AS version FROM vocabulary WHERE retired_at IS NULL""")
def _version(t):
    return tags.vocabulary_version(t.vocabulary())


@query("recent_tags", """
SELECT name, epoch_us(used_at) AS used_at FROM vocabulary WHERE retired_at IS NULL AND used_at IS NOT NULL
ORDER BY used_at DESC, lower(name)""")
def _recent(t):
    return tags.recent_tags(t.vocabulary()).withColumn("used_at", F.unix_micros("used_at"))


# Requests: one per event, on a page seen then, some on addresses no snapshot holds.
SQL_VIEWS["tag_requests"] = """
SELECT CASE WHEN event_id % 37 = 0 THEN url || '?none' ELSE url END AS url, event_id AS seq,
  CASE event_type WHEN 'click' THEN 'remove' WHEN 'signup' THEN 'clear' ELSE 'add' END AS action,
  CASE event_id % 4 WHEN 0 THEN 'SRC' || (user_id % 20) WHEN 1 THEN 'en' WHEN 2 THEN 'Fresh ' || (user_id % 9)
    ELSE 'toxic' END AS name FROM page_events JOIN pages USING (page_id)"""
SQL_VIEWS["last_requests"] = """
SELECT url, lower(name) AS fold, arg_max(action, seq) AS action, arg_max(name, seq) AS name, min(seq) AS first_seq
FROM tag_requests GROUP BY 1, 2"""
SQL_VIEWS["new_terms"] = """
SELECT coalesce(v.fold, a.fold) AS fold, coalesce(v.name, a.typed) AS spelling, v.name IS NULL AS created,
  v.retired_at IS NOT NULL AND a.typed IS NOT NULL AS revived
FROM (SELECT *, lower(name) AS fold FROM vocabulary) v FULL JOIN (SELECT fold, arg_min(name, (first_seq, url)) AS typed
  FROM last_requests WHERE action = 'add' AND url IN (SELECT url FROM pages) GROUP BY fold) a ON a.fold = v.fold"""
SQL_VIEWS["tag_outcome"] = """
SELECT r.url, r.fold, n.spelling, r.action, o.side AS before,
  CASE WHEN r.url NOT IN (SELECT url FROM pages) THEN 'unknown page' WHEN n.spelling IS NULL THEN 'unknown name'
    WHEN o.side IS NOT DISTINCT FROM nullif(r.action, 'clear') THEN 'unchanged' ELSE 'changed' END AS outcome
FROM last_requests r LEFT JOIN new_terms n USING (fold) LEFT JOIN owned o ON o.url = r.url AND o.fold = r.fold"""


def requests(t: Tables):
    e = F.col("event_id")
    name = (F.when(e % 4 == 0, F.concat(F.lit("SRC"), (F.col("user_id") % 20).cast("string")))
            .when(e % 4 == 1, "en").when(e % 4 == 2, F.concat(F.lit("Fresh "), (F.col("user_id") % 9).cast("string")))
            .otherwise("toxic"))
    return t.page_events().join(t.raw("pages").select("page_id", "url"), "page_id").select(
        F.when(e % 37 == 0, F.concat("url", F.lit("?none"))).otherwise(F.col("url")).alias("url"), e.alias("seq"),
        F.when(F.col("event_type") == "click", "remove").when(F.col("event_type") == "signup", "clear")
        .otherwise("add").alias("action"), name.alias("name"))


def applied(t: Tables):
    return tags.apply_tags(requests(t), t.page_tags(), t.vocabulary(), t.raw("pages"), now())


@query("apply_tags", """
SELECT url, name, side FROM page_tags p WHERE NOT EXISTS (SELECT 1 FROM tag_outcome x WHERE x.url = p.url
  AND x.fold = lower(p.name) AND x.outcome IN ('changed', 'unchanged'))
UNION ALL SELECT url, spelling, action FROM tag_outcome WHERE outcome IN ('changed', 'unchanged') AND action <> 'clear'""")
def _apply(t):
    return applied(t)["page_tags"]


@query("apply_tags_outcome", "SELECT url, fold, spelling, action, before, outcome FROM tag_outcome")
def _apply_outcome(t):
    return applied(t)["outcome"].drop("after")


@query("apply_tags_vocabulary", """
SELECT n.spelling AS name, n.created, CASE WHEN n.revived THEN NULL ELSE epoch_us(v.retired_at) END AS retired_at,
  CASE WHEN n.fold IN (SELECT fold FROM tag_outcome WHERE outcome = 'changed' AND action = 'add')
    THEN 1735689600000000 ELSE epoch_us(v.used_at) END AS used_at
FROM new_terms n LEFT JOIN vocabulary v ON lower(v.name) = n.fold""")
def _apply_vocabulary(t):
    v = applied(t)["vocabulary"]
    return v.select("name", (F.col("created_at") == now()).alias("created"), F.unix_micros("retired_at").alias("retired_at"),
                    F.unix_micros("used_at").alias("used_at"))


@query("undo_tags", "SELECT url, name, side FROM page_tags")
def _undo(t):
    after = applied(t)
    changed = after["outcome"].where("outcome = 'changed'").select("url", "fold", "before")
    return tags.undo_tags(changed, after["page_tags"], after["vocabulary"], t.raw("pages"))


SQL_VIEWS["vocabulary_edits"] = """
SELECT CASE doc_id % 3 WHEN 0 THEN upper(source) WHEN 1 THEN lang || '-' || (doc_id % 6) ELSE source || 'x' END AS name,
  CASE WHEN doc_id % 3 = 0 THEN CASE WHEN regexp_matches(source, '[2468]$') THEN 'retire' ELSE 'define' END
    WHEN doc_id % 3 = 1 THEN 'create' WHEN doc_id % 2 = 0 THEN 'create' ELSE 'retire' END AS action,
  'Defined ' || doc_id AS definition, doc_id AS seq FROM documents"""
SQL_VIEWS["edit_sums"] = """
SELECT lower(name) AS fold, bool_or(action <> 'retire') AS comes, bool_or(action = 'retire') AS goes,
  arg_max(definition, seq) FILTER (action = 'define') AS d, arg_min(name, seq) AS typed FROM vocabulary_edits GROUP BY 1"""


def _edits(t: Tables):
    k = F.col("doc_id") % 3
    d = t.raw("documents")
    return d.select(
        F.when(k == 0, F.upper("source")).when(k == 1, F.concat("lang", F.lit("-"), (F.col("doc_id") % 6).cast("string")))
        .otherwise(F.concat("source", F.lit("x"))).alias("name"),
        F.when(k == 0, F.when(F.col("source").rlike("[2468]$"), "retire").otherwise("define")).when(k == 1, "create")
        .when(F.col("doc_id") % 2 == 0, "create").otherwise("retire").alias("action"),
        F.concat(F.lit("Defined "), F.col("doc_id").cast("string")).alias("definition"), F.col("doc_id").alias("seq"))


@query("edit_vocabulary", """
SELECT coalesce(v.name, e.typed) AS name,
  (CASE WHEN comes AND NOT goes THEN NULL WHEN goes AND NOT comes THEN coalesce(epoch_us(retired_at), 1735689600000000)
    ELSE epoch_us(retired_at) END)::BIGINT AS retired_at,
  CASE WHEN comes AND NOT goes AND d IS NOT NULL THEN d ELSE v.definition END AS definition
FROM vocabulary v FULL JOIN edit_sums e ON e.fold = lower(v.name) WHERE v.name IS NOT NULL OR (comes AND NOT goes)""")
def _edit(t):
    v = tags.edit_vocabulary(_edits(t), t.vocabulary(), now())["vocabulary"]
    return v.select("name", F.unix_micros("retired_at").alias("retired_at"), "definition")


@query("edit_vocabulary_problems", """
SELECT coalesce(v.name, e.typed) AS name, CASE WHEN comes AND goes THEN 'named both to keep and to retire'
  ELSE 'unknown tag' END AS problem
FROM edit_sums e LEFT JOIN vocabulary v ON e.fold = lower(v.name) WHERE goes AND (comes OR v.name IS NULL)""")
def _edit_problems(t):
    return tags.edit_vocabulary(_edits(t), t.vocabulary(), now())["problems"]


SQL_VIEWS["hide_requests"] = """
SELECT url, CASE arg_max(event_type, seq) WHEN 'click' THEN 'restore' ELSE 'forget' END AS action FROM
 (SELECT CASE WHEN event_id % 41 = 0 THEN url || '?none' ELSE url END AS url, event_type, event_id AS seq
  FROM page_events JOIN pages USING (page_id) WHERE event_type IN ('click', 'signup')) GROUP BY url"""


def _hide(t: Tables):
    e = F.col("event_id")
    r = (t.page_events().where(F.col("event_type").isin("click", "signup"))
         .join(t.raw("pages").select("page_id", "url"), "page_id").select(
        F.when(e % 41 == 0, F.concat("url", F.lit("?none"))).otherwise(F.col("url")).alias("url"), e.alias("seq"),
        F.when(F.col("event_type") == "click", "restore").otherwise("forget").alias("action")))
    return tags.forget_restore(r, t.forgotten(), t.raw("pages"))


@query("forget_restore", """
SELECT url FROM forgotten WHERE url NOT IN (SELECT url FROM hide_requests WHERE action = 'restore')
UNION SELECT url FROM hide_requests WHERE action = 'forget' AND url IN (SELECT url FROM pages)""")
def _forget(t):
    return _hide(t)["forgotten"]


@query("forget_restore_outcome", """
SELECT url, action, CASE WHEN url NOT IN (SELECT url FROM pages) THEN 'unknown'
  WHEN (action = 'forget') = (url IN (SELECT url FROM forgotten)) THEN 'unchanged' ELSE 'changed' END AS outcome
FROM hide_requests""")
def _forget_outcome(t):
    return _hide(t)["outcome"]


# Answers: one line per document, a clean batch and one with mistakes.
_ANSWERS = """SELECT doc_id AS line, url, ['  ' || upper(lang), 'Src' || (doc_id % 12)] AS tags, 'Click' AS source
FROM documents JOIN pages ON page_id = doc_id WHERE doc_id % 2 = 0"""
SQL_VIEWS["bad_answers"] = """
SELECT doc_id AS line, CASE WHEN doc_id % 7 = 0 THEN url || '?none' ELSE url END AS url,
  CASE WHEN doc_id % 5 = 0 THEN ' ' WHEN doc_id % 5 = 1 THEN 'never heard of' ELSE lang END AS tag,
  CASE WHEN doc_id % 11 = 10 THEN 'Other' WHEN doc_id % 13 = 12 THEN '' ELSE 'Click' END AS source
FROM documents JOIN pages ON page_id = doc_id % (SELECT count(*) FROM pages)"""


@query("import_suggestions", f"""
WITH a AS ({_ANSWERS}),
n AS (SELECT *, list_sort(list_distinct([lower(trim(tags[1])), lower(tags[2])])) AS folds, 'v1' AS version FROM a),
l AS (SELECT url, list_sort(list_distinct([lower(tags[1]), lower(tags[2])])) AS folds, vocabulary_version AS version
  FROM (SELECT *, row_number() OVER (PARTITION BY url, lower(source) ORDER BY seq DESC) AS rn FROM suggested
        WHERE lower(source) = 'click') WHERE rn = 1)
SELECT line, url, source, array_to_string(folds, ',') AS folds, version FROM n
WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.url = n.url AND l.folds = n.folds AND l.version = n.version)""")
def _import(t):
    d = t.raw("documents").where("doc_id % 2 = 0").join(
        t.raw("pages").select(F.col("page_id").alias("doc_id"), "url"), "doc_id")
    answers = d.select(F.col("doc_id").alias("line"), "url", F.array(
        F.concat(F.lit("  "), F.upper("lang")), F.concat(F.lit("Src"), (F.col("doc_id") % 12).cast("string"))).alias("tags"),
        F.lit("Click").alias("source"))
    lines = tags.import_suggestions(answers, t.suggested(), t.vocabulary(), t.raw("pages"), accept_new=True,
                                    version=F.lit("v1"))["lines"]
    return lines.select("line", "url", "source", F.array_join("folds", ",").alias("folds"), "version")


def _bad(t: Tables):
    d = t.raw("documents").withColumn("page_id", F.col("doc_id") % t.count_of("pages")).join(
        t.raw("pages").select("page_id", "url"), "page_id")
    k = F.col("doc_id")
    tag = F.when(k % 5 == 0, " ").when(k % 5 == 1, "never heard of").otherwise(F.col("lang"))
    answers = d.select(k.alias("line"), F.when(k % 7 == 0, F.concat("url", F.lit("?none"))).otherwise(F.col("url")).alias("url"),
                       F.array(tag).alias("tags"), F.when(k % 11 == 10, "Other").when(k % 13 == 12, "").otherwise("Click").alias("source"))
    return tags.import_suggestions(answers, t.suggested(), t.vocabulary(), t.raw("pages"), t.raw("pages"))


@query("import_suggestions_problems", """
SELECT line, problem FROM (
  SELECT line, 'repeated page' AS problem FROM bad_answers b WHERE line > (SELECT min(line) FROM bad_answers c WHERE c.url = b.url)
  UNION ALL SELECT line, 'not in the library' FROM bad_answers WHERE url NOT IN (SELECT url FROM pages)
  UNION ALL SELECT line, 'no source' FROM bad_answers WHERE source = ''
  UNION ALL SELECT line, 'another source' FROM bad_answers WHERE source = 'Other'
  UNION ALL SELECT line, 'bad tag: it is empty' FROM bad_answers WHERE tag = ' '
  UNION ALL SELECT line, 'no such tag' FROM bad_answers WHERE tag = 'never heard of'
  UNION ALL SELECT 0, 'page without a line' FROM pages WHERE url NOT IN (SELECT url FROM bad_answers))""")
def _bad_problems(t):
    return _bad(t)["problems"]


@query("import_suggestions_refused", "SELECT count(*) AS stored FROM pages WHERE false")
def _bad_lines(t):
    return _bad(t)["lines"].agg(F.count(F.lit(1)).alias("stored"))


# Not relevant marks: per source of documents one query whose results are its documents by id.
SQL_VIEWS["results"] = """
SELECT source AS query, doc_id::VARCHAR AS url, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents"""
SQL_VIEWS["marked_before"] = """
SELECT query, url, rank, CASE WHEN rank % 2 = 0 THEN 'cut' ELSE 'click' END AS cause FROM results WHERE rank % 5 = 1 OR rank % 7 = 2"""
SQL_VIEWS["mark_actions"] = """
SELECT query, ['exclude', 'include', 'cut', 'uncut'][(length(query) + ascii(right(query, 1))) % 4 + 1] AS action, url, rank AS at_rank
FROM results WHERE rank = 6"""


def _excluded(t: Tables):
    from pagelib.functions import ordered
    d = t.raw("documents").select(F.col("source").alias("query"), "doc_id", F.col("doc_id").cast("string").alias("url"))
    shown = ordered.row_number(d, ["query"], [F.col("doc_id")], [ordered.Coarse(ordered.id_bucket("doc_id"))], "rank").drop("doc_id")
    state = shown.where("rank % 5 = 1 or rank % 7 = 2").withColumn("cause", F.when(F.col("rank") % 2 == 0, "cut").otherwise("click"))
    kinds = F.array(*[F.lit(a) for a in ("exclude", "include", "cut", "uncut")])
    which = (F.length("query") + F.ascii(F.right("query", F.lit(1)))) % 4
    actions = shown.where("rank = 6").select("query", F.get(kinds, which).alias("action"), "url")
    return shown, tags.exclude_results(state, shown, actions)


SQL_VIEWS["marked_after"] = """
SELECT m.query, m.url, m.rank, m.cause FROM marked_before m LEFT JOIN mark_actions a USING (query)
WHERE NOT coalesce((action = 'include' AND m.url = a.url) OR (action IN ('cut', 'uncut') AND cause = 'cut'), false)"""
SQL_VIEWS["marked_new"] = """
SELECT * FROM marked_after UNION ALL
SELECT r.query, r.url, r.rank, CASE WHEN action = 'cut' THEN 'cut' ELSE 'click' END FROM results r JOIN mark_actions a USING (query)
WHERE ((action = 'exclude' AND r.url = a.url) OR (action = 'cut' AND r.rank > a.at_rank))
  AND NOT EXISTS (SELECT 1 FROM marked_after k WHERE k.query = r.query AND k.url = r.url)"""


@query("exclude_results", "SELECT query, url, rank, cause FROM marked_new")
def _exclude_results(t):
    return _excluded(t)[1]["excluded"]


@query("cover_new_results", """
SELECT query, url, rank, cause FROM marked_new
UNION ALL SELECT r.query, r.url || 'n', r.rank + 1, 'cut' FROM results r JOIN mark_actions a USING (query)
WHERE action = 'cut' AND r.rank + 1 > a.at_rank""")
def _cover(t):
    shown, marks = _excluded(t)
    later = shown.unionByName(shown.select("query", F.concat("url", F.lit("n")).alias("url"), (F.col("rank") + 1).alias("rank")))
    return tags.cover_new_results(marks["excluded"], marks["cuts"], marks["seen"], later)


@query("add_pages", f"""
WITH k AS (SELECT page_id * 100 + variant AS id, url, clean AS key, CASE WHEN NOT web THEN 'not a web page'
    WHEN {PRIVATE} THEN 'private network' WHEN ({DOMAIN}) IS NULL THEN 'not listed' END AS reason FROM clean_urls),
s AS (SELECT c.url, c.clean AS key, c.url IN (SELECT url FROM forgotten) AS gone FROM clean_urls c WHERE variant = 0),
e AS (SELECT *, (SELECT gone FROM s WHERE s.url = k.url) AS g1, (SELECT gone FROM s WHERE s.url = k.key) AS g2,
  (SELECT min(gone::INT::VARCHAR || s.url) FROM s WHERE s.key = k.key) AS best FROM k)
SELECT id, url, CASE WHEN reason IS NOT NULL THEN 'refused' WHEN coalesce(g1, g2) IS NOT NULL
    THEN CASE WHEN coalesce(g1, g2) THEN 'forgotten' ELSE 'known' END
    WHEN best IS NOT NULL THEN CASE WHEN best[1] = '1' THEN 'forgotten' ELSE 'known' END ELSE 'added' END AS outcome,
  CASE WHEN reason IS NOT NULL THEN NULL WHEN g1 IS NOT NULL THEN url WHEN g2 IS NOT NULL THEN key
    WHEN best IS NOT NULL THEN best[2:] ELSE key END AS held, reason FROM e""")
def _add_pages(t):
    r = t.url_variants().select((F.col("page_id") * 100 + F.col("variant")).alias("id"), "url", F.lit(" ").alias("title"))
    return tags.add_pages(r, t.raw("pages").select("url"), t.forgotten()).drop("title")
