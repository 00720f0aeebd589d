"""Search over the documents, and vector work over the embeddings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from pagelib.functions import vectors as V
from pagelib.operators import library_search, neighbours, search, term_index
from pagelib.operators import vectors as vec
from pagelib.plans.registry import query
from pagelib.plans.tables import SQL_VIEWS, Tables
from pagelib.session import materialise, scratch, shared_folder

STOP = ["the", "and", "de", "le", "la", "und", "der"]
QUERY = "than the Ha que die esher and than"
WORDS = [w for w in QUERY.lower().split()]
_STOPS = ", ".join(f"'{w}'" for w in STOP)
_MATCH = " AND ".join(f"(contains(lower(title), '{w}') OR contains(lower(url), '{w}') OR contains(lower(text), '{w}'))" for w in ["th", "on", "en"])


def _field(f: str) -> str:
    return f"CASE WHEN {' OR '.join(f'''contains(lower({f}), '{w}')''' for w in ['th', 'on', 'en'])} THEN '{f}' END"


SQL_VIEWS["matched_docs"] = f"""
SELECT id, concat_ws(',', {_field('title')}, {_field('url')}, {_field('text')}) AS matched FROM search_docs WHERE {_MATCH}"""


@query("keyword_match", "SELECT id, matched FROM matched_docs")
def _match(t):
    return search.keyword_match_apart(t.search_docs(), t.texts(), "Th  on EN")


SQL_VIEWS["term_counts"] = f"""
SELECT id, term, count(*) AS n FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term
  FROM documents) WHERE term NOT IN ({_STOPS}) GROUP BY 1, 2"""
SQL_VIEWS["term_idf"] = """
SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM term_counts GROUP BY term"""
SQL_VIEWS["term_rows"] = """
SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM
  (SELECT id, term, (1 + ln(n)) * idf AS w FROM term_counts JOIN term_idf USING (term))"""
_QTF = {w: WORDS.count(w) for w in WORDS}
SQL_VIEWS["query_terms"] = f"""
SELECT term, w / sqrt(sum(w * w) OVER ()) AS q FROM (SELECT term, (1 + ln(CASE term {' '.join(f"WHEN '{w}' THEN {n}" for w, n in _QTF.items())} END)) * idf AS w
  FROM term_idf WHERE term IN ({', '.join(f"'{w}'" for w in _QTF)}))"""
SQL_VIEWS["keyword_scores"] = """
SELECT id, round(sum(weight * q), 9) AS score FROM term_rows JOIN query_terms USING (term) GROUP BY id HAVING round(sum(weight * q), 9) > 0"""


def index(t: Tables):
    return search.tfidf_index(t.texts(), STOP)


_STORED: dict[tuple, term_index.TermIndex] = {}


def stored_index(t: Tables) -> term_index.TermIndex:
    """The index of the documents in the shared folder: a session builds it once for a table and asks it from then on."""
    docs = t.texts()
    key = (t.spark.sparkContext.applicationId, shared_folder(t.spark), *sorted(docs.inputFiles()))
    if key not in _STORED:
        _STORED[key] = term_index.build_index(docs, scratch(t.spark, "term-index"), STOP, blocks=16)
    return _STORED[key]


def keyword_scores(t: Tables):
    return stored_index(t).scores(QUERY)


@query("tfidf_index", "SELECT id, term, round(weight, 6) AS weight FROM term_rows")
def _index(t):
    return index(t)[0].withColumn("weight", F.round("weight", 6))


@query("tfidf_scores", "SELECT id, round(score, 6) AS score FROM keyword_scores")
def _scores(t):
    return keyword_scores(t).withColumn("score", F.round("score", 6))


@query("tfidf_scores_unstored", "SELECT id, round(score, 6) AS score FROM keyword_scores")
def _unstored(t):
    return search.tfidf_scores(*index(t), QUERY).withColumn("score", F.round("score", 6))


# Documents with id % 10 = 3 come later, those with id % 10 = 4 have another's text at first, those with id % 10 = 5 go.
SQL_VIEWS["updated_counts"] = "SELECT * FROM term_counts WHERE id % 10 <> 5"
SQL_VIEWS["updated_idf"] = """
SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM documents WHERE doc_id % 10 <> 5)) / (1 + count(*))) + 1 AS idf FROM updated_counts GROUP BY term"""


@query("update_index", """
SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM
  (SELECT id, term, (1 + ln(n)) * idf AS w FROM updated_counts JOIN updated_idf USING (term))""")
def _updated(t):
    docs = t.raw("documents").select(F.col("doc_id").alias("id"), "text")
    lot = F.col("id") % 10
    first = docs.where(lot != 3).withColumn("text", F.when(lot == 4, F.reverse("text")).otherwise(F.col("text")))
    built = term_index.build_index(first, scratch(t.spark, "term-index"), STOP, blocks=16)
    newer = term_index.update_index(built, docs.where(lot.isin(3, 4)), docs.where(lot == 5))
    return newer.rows().withColumn("weight", F.round("weight", 6))


@query("title_ngram_index", """
WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents),
c AS (SELECT id, term, count(*) AS n FROM (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))
  AS term FROM w) GROUP BY 1, 2),
i AS (SELECT term, ln((1 + (SELECT count(*) FROM documents WHERE doc_id % 3 <> 0)) / (1 + count(*))) + 1 AS idf FROM c
  WHERE id % 3 <> 0 GROUP BY term HAVING count(*) >= 2)
SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM
  (SELECT id, term, (1 + ln(n)) * idf AS w FROM c JOIN i USING (term))""")
def _ngrams(t):
    d = t.raw("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"))
    return search.title_ngram_index(d, d.where("id % 3 <> 0")).withColumn("weight", F.round("weight", 6))


# --- vectors

SQL_VIEWS["dims"] = "SELECT id, label, unnest(vector)::DOUBLE AS x, unnest(range(1, len(vector) + 1)) AS pos FROM vectors"


def _unit(inner: str, keys: str) -> str:
    """Unit vectors of (keys, pos, x) rows as lists."""
    return (f"SELECT {keys}, list(x / greatest(n, 1e-12) ORDER BY pos) AS vector FROM (SELECT *, sqrt(sum(x * x) OVER "
            f"(PARTITION BY {keys})) AS n FROM ({inner})) GROUP BY {keys}")


SQL_VIEWS["label_queries"] = _unit("SELECT label AS tag, pos, avg(x) AS x FROM dims WHERE id % 2 = 0 GROUP BY 1, 2", "tag")
SQL_VIEWS["wide"] = "SELECT id, label, vector::DOUBLE[] AS vector FROM vectors"
SQL_VIEWS["q3"] = "SELECT vector FROM label_queries WHERE tag = 3"
SQL_VIEWS["q3_scores"] = "SELECT id, round(list_dot_product(w.vector, q3.vector), 9) AS score FROM wide w, q3"


def label_queries(t: Tables):
    v = t.vectors()
    return vec.class_means(v, v.where("id % 2 = 0").select("id", F.col("label").alias("tag")))


def q3(t: Tables):
    return label_queries(t).where("tag = 3").select("vector").scalar()


def two_steps(col: str = "score"):
    return F.round(col, 6)


@query("cosine_scores", "SELECT id, round(score, 6) AS score FROM q3_scores")
def _cosine(t):
    return vec.cosine_scores(t.vectors(), q3(t)).withColumn("score", two_steps())


@query("rank_source", "SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM q3_scores")
def _rank(t):
    return search.rank_source(vec.cosine_scores(t.vectors(), q3(t))).select("id", "rank")


# Page i has vector i and document i.
SQL_VIEWS["fused"] = """
SELECT id, coalesce(score, 0) AS text_score, coalesce(t.rank, 0) AS text_rank, coalesce(k.kscore, 0) AS keyword_score, coalesce(k.krank, 0) AS keyword_rank,
  round(coalesce(1 / (60 + t.rank), 0) + coalesce(1 / (60 + k.krank), 0), 12) AS fused
FROM (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM q3_scores WHERE id % 7 <> 0) t
LEFT JOIN (SELECT id, score AS kscore, row_number() OVER (ORDER BY score DESC, id) AS krank FROM keyword_scores
  WHERE id % 7 <> 0 AND id IN (SELECT id FROM vectors)) k USING (id)"""
SQL_VIEWS["hits"] = "SELECT *, row_number() OVER (ORDER BY fused DESC, id) AS place FROM fused"


def hits(t: Tables):
    among = t.vectors().where("id % 7 <> 0").select("id")
    keyword = materialise(keyword_scores(t), "keyword")
    return search.hybrid_search(t.vectors(), q3(t), keyword, among)


@query("hybrid_search", """
SELECT id, round(fused, 6) AS fused, round(text_score, 6) AS text_score, text_rank, round(keyword_score, 6) AS keyword_score, keyword_rank, place FROM hits""")
def _hybrid(t):
    return hits(t).select("id", two_steps("fused").alias("fused"), two_steps("text_score").alias("text_score"), "text_rank",
                          two_steps("keyword_score").alias("keyword_score"), "keyword_rank", "place")


@query("search_page", "SELECT id, place FROM hits WHERE place > 20 AND place <= 45")
def _page(t):
    return search.search_page(hits(t), 20, 25).select("id", "place")


@query("rrf", """
SELECT id, round(sum(1 / (60 + r)), 6) AS fused FROM (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM q3_scores
  UNION ALL SELECT id, row_number() OVER (ORDER BY round(vector[1], 9) DESC, id) FROM wide
  UNION ALL SELECT id, row_number() OVER (ORDER BY round(vector[2], 9) DESC, id) FROM wide WHERE vector[2] > 0) GROUP BY id""")
def _rrf(t):
    v = t.vectors()
    one = lambda i: v.select("id", F.round(F.get("vector", F.lit(i)).cast("double"), 9).alias("score"))
    out = search.rrf({"text": vec.cosine_scores(v, q3(t)), "keyword": one(0), "image": v.where(F.get("vector", F.lit(1)) > 0).select(
        "id", F.round(F.get("vector", F.lit(1)).cast("double"), 9).alias("score"))}, v)
    return out.select("id", two_steps("fused").alias("fused"))


# Chunks: every vector is a chunk of page id // 3.
SQL_VIEWS["chunk_scores"] = """
SELECT id, id // 3 AS page_id, id % 3 * 100 AS start, id % 3 * 100 + 90 AS stop, round(list_dot_product(w.vector, q3.vector), 9) AS score
FROM wide w, q3"""


def chunks(t: Tables):
    i = F.col("id")
    return t.vectors().select("id", F.floor(i / 3).alias("page_id"), (i % 3 * 100).alias("start"), (i % 3 * 100 + 90).alias("end"),
                              "vector", F.sha2(F.floor(i / 3).cast("string"), 256).alias("content_sha256"))


@query("chunk_winner", """
SELECT page_id, arg_min(id, (-score, start, stop, id)) AS id, arg_min(start, (-score, start, stop, id)) AS start, round(max(score), 6) AS score
FROM chunk_scores WHERE page_id % 5 <> 0 GROUP BY page_id""")
def _winner(t):
    among = t.vectors().where("id % 5 <> 0").select("id")
    return search.chunk_winner(chunks(t), q3(t), among).select("page_id", "id", "start", two_steps().alias("score"))


_ALIVE = "SELECT id, CASE WHEN id % 4 = 0 THEN sha256('new' || id) ELSE sha256(id::VARCHAR) END AS h FROM vectors"


def _statuses(t: Tables):
    i = F.col("id").cast("string")
    among = t.vectors().select("id", F.when(F.col("id") % 4 == 0, F.sha2(F.concat(F.lit("new"), i), 256)).otherwise(
        F.sha2(i, 256)).alias("content_sha256"))
    return search.chunk_staleness(among, chunks(t))


SQL_VIEWS["chunk_states"] = f"""
SELECT a.id, CASE WHEN c.page_id IS NULL THEN 'missing' WHEN a.id % 4 = 0 THEN 'stale' ELSE 'ready' END AS chunk_status
FROM ({_ALIVE}) a LEFT JOIN (SELECT DISTINCT page_id FROM chunk_scores) c ON c.page_id = a.id"""


@query("chunk_staleness", "SELECT id, chunk_status FROM chunk_states")
def _stale(t):
    return _statuses(t).select("id", "chunk_status")


@query("chunk_fallback_counts", """
SELECT 'chunks_' || chunk_status AS code, count(*) AS affected_pages FROM chunk_states WHERE chunk_status <> 'ready' GROUP BY 1""")
def _fallback(t):
    return search.fallback_counts(_statuses(t))


SQL_VIEWS["merged_hits"] = """
SELECT url, row_number() OVER (ORDER BY part, k, url) AS place, part = 0 AS ranked FROM (
  SELECT id AS url, 0 AS part, place AS k FROM hits WHERE id IN (SELECT id FROM search_docs)
  UNION ALL SELECT m.id, 1, m.id FROM matched_docs m ANTI JOIN hits USING (id))"""


def merged(t: Tables, top=None):
    docs = t.search_docs()
    entries = docs.select(F.col("id").alias("url"), F.col("id").alias("pos"))
    ranked = hits(t).select(F.col("id").alias("url"), F.col("place").alias("rank"))
    matched = search.keyword_match_apart(docs, t.texts(), "th on en").select(F.col("id").alias("url"))
    return search.merge_ranked(entries, ranked, matched, top)


@query("merge_ranked", "SELECT * FROM merged_hits")
def _merge(t):
    return search.numbered_results(materialise(merged(t), "merged")).select("url", "place", "ranked")


@query("top_n_then_tail", """
SELECT id AS url, 0 AS part FROM (SELECT * FROM hits WHERE id IN (SELECT id FROM search_docs) ORDER BY place LIMIT 50)
UNION ALL SELECT m.id, 1 FROM matched_docs m ANTI JOIN hits USING (id)""")
def _top(t):
    return merged(t, 50).select("url", "part")


@query("page_results", """
SELECT m.url, place, (SELECT count(*) FROM merged_hits) AS total, 'v1:' || least(20, (SELECT count(*) FROM merged_hits)) AS next
FROM merged_hits m WHERE place <= 20""")
def _page_results(t):
    r = materialise(search.numbered_results(materialise(merged(t), "merged")), "results")
    p = search.page_results(r, "than the", 20)
    return p.select("url", "place", "total", F.regexp_extract("next", r"^(v1:\d+):[0-9a-f]{64}$", 1).alias("next"))


@query("combined_search", """
SELECT d.url, m.place, ranked, coalesce(list_contains(['en', 'fr'], d.lang), false) AS shown_lang, coalesce(matched, '') AS matched,
  chunk_status FROM merged_hits m JOIN search_docs d ON d.id = m.url LEFT JOIN matched_docs k ON k.id = m.url
JOIN chunk_states c ON c.id = m.url WHERE m.place <= 100""")
def _combined(t):
    results = search.numbered_results(materialise(merged(t), "merged"))
    page = search.search_page(results, 0, 100)
    docs = t.search_docs()
    matched = search.keyword_match_apart(docs, t.texts(), "th on en")
    states = _statuses(t).select("id", "chunk_status")
    return (page.withColumnRenamed("url", "id").join(docs.select("id", "url", "lang"), "id").join(matched, "id", "left").join(states, "id")
            .select("url", "place", "ranked", F.col("lang").isin("en", "fr").alias("shown_lang"), F.coalesce("matched", F.lit("")).alias("matched"),
                    "chunk_status"))


# Search as one operator. Every document is a page added at its own minute; every third chunk is of an older body; each fourth
# page has an image, with the vector of the page before it.
SQL_VIEWS["asked_docs"] = """
SELECT id, title, text, url, lang, source, TIMESTAMP '2024-01-01' + to_minutes(id) AS added_at FROM search_docs
WHERE lang = 'en' AND id >= 20 AND id < 6000"""
SQL_VIEWS["asked_scores"] = """
SELECT a.id, coalesce(CASE WHEN a.id % 4 = 0 THEN NULL ELSE c.score END, s.score) AS score FROM asked_docs a JOIN q3_scores s USING (id)
LEFT JOIN (SELECT page_id AS id, max(score) AS score FROM chunk_scores GROUP BY page_id) c USING (id)"""
SQL_VIEWS["asked_fused"] = """
SELECT id, row_number() OVER (ORDER BY f DESC, id) AS place FROM (
  SELECT id, round(sum(1 / (60 + r)), 12) AS f FROM (
    SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM asked_scores
    UNION ALL SELECT id, row_number() OVER (ORDER BY k.score DESC, id) FROM keyword_scores k JOIN asked_scores a USING (id)
    UNION ALL SELECT a.id, row_number() OVER (ORDER BY s.score DESC, a.id) FROM asked_scores a JOIN q3_scores s ON s.id = a.id - 1 WHERE a.id % 4 = 1) GROUP BY id)"""
SQL_VIEWS["asked_hits"] = """
SELECT id, row_number() OVER (ORDER BY part, k, id) AS place, part = 0 AS ranked FROM (
  SELECT id, 0 AS part, place AS k FROM asked_fused
  UNION ALL SELECT m.id, 1, m.id FROM matched_docs m JOIN asked_docs USING (id) ANTI JOIN asked_fused USING (id))"""
SQL_VIEWS["asked_chunks"] = """
SELECT page_id AS id, arg_min(start, (-score, start, stop, id)) AS start, arg_min(stop, (-score, start, stop, id)) AS stop FROM chunk_scores GROUP BY page_id"""
ASKED = library_search.Ask("Th  on EN", tags=("EN",), kinds=("web",), after="2024-01-01T00:20:00", before="2024-01-05T04:00:00")


def asked(t: Tables, ask: library_search.Ask = ASKED):
    """(result, pages, bodies) of a search with chunks, images and filters."""
    d, i, v = t.search_docs(), F.col("id"), t.vectors()
    pages = d.select("id", "url", "title", F.array("lang", "source").alias("tags"), i.alias("pos"),
                     F.timestamp_seconds(F.lit(1704067200) + i * 60).alias("added_at"))
    key = i.cast("string")
    bodies = t.texts().select("id", "text", F.when(i % 4 == 0, F.sha2(F.concat(F.lit("new"), key), 256)).otherwise(F.sha2(key, 256)).alias("content_sha256"))
    images = v.where("id % 4 = 0").select((i + 1).alias("id"), "vector")
    ranking = library_search.Ranking(q3(t), v.select("id", "vector"), materialise(keyword_scores(t), "keyword"), images, chunks(t))
    return library_search.search_library(pages, bodies, ask, ranking), pages, bodies


def _hits_sql(low: int, high: int) -> str:
    return f"""
SELECT d.id, d.url, h.place, ranked, coalesce(k.matched, '') AS matched, CASE WHEN c.id IS NULL THEN 'missing' WHEN d.id % 4 = 0 THEN 'stale' ELSE 'ready' END AS chunk_status,
  CASE WHEN d.id % 4 <> 0 THEN c.start END AS chunk_start, CASE WHEN d.id % 4 <> 0 THEN substr(decode(encode(d.text)[c.start + 1:c.stop]), 1, 200) END AS span
FROM asked_hits h JOIN asked_docs d ON d.id = h.id LEFT JOIN matched_docs k ON k.id = h.id LEFT JOIN asked_chunks c ON c.id = h.id
WHERE h.place > {low} AND h.place <= {high}"""


def _shown(page: library_search.Page):
    return page.hits.select("id", "url", "place", "ranked", "matched", "chunk_status", "chunk_start",
                            F.when(F.col("chunk_start").isNotNull(), F.col("snippet")).alias("span"))


@query("library_search", _hits_sql(0, 25))
def _asked(t):
    return _shown(library_search.result_page(*asked(t), 25))


@query("library_search_next", _hits_sql(25, 60))
def _asked_next(t):
    found = asked(t)
    first = library_search.result_page(*found, 25).about.first()
    return _shown(library_search.result_page(*found, 35, first["next"]))


@query("library_search_about", """
SELECT w.what, 'hybrid' AS ranking, n AS total, CASE WHEN w.what = 'stale' THEN 0 ELSE least(25, n) END AS returned, w.what = 'stale' AS stale,
  w.what <> 'stale' AND n > 25 AS truncated FROM (SELECT count(*) AS n FROM asked_hits), (SELECT unnest(['first', 'stale']) AS what) w""")
def _asked_about(t):
    """What a search says of its pages; a cursor of another question is stale."""
    from dataclasses import replace

    first = library_search.result_page(*asked(t, replace(ASKED, query="th on")), 25).about.first()
    found = asked(t)
    rows = [library_search.result_page(*found, 25, cursor).about.withColumn("what", F.lit(what))
            for what, cursor in (("first", None), ("stale", first["next"] or f"v1:0:{'0' * 64}"))]
    return rows[0].unionByName(rows[1]).select("what", "ranking", "total", "returned", "stale", "truncated")


@query("library_search_fallback", """
SELECT 'chunks_' || s AS code, count(*) AS affected_pages FROM (SELECT CASE WHEN c.id IS NULL THEN 'missing' WHEN d.id % 4 = 0 THEN 'stale' END AS s
  FROM asked_docs d LEFT JOIN asked_chunks c USING (id)) WHERE s IS NOT NULL GROUP BY 1""")
def _asked_fallback(t):
    return asked(t)[0].fallback


SQL_VIEWS["refined"] = _unit("""
SELECT 1 AS one, pos, q.x + p.x - 0.25 * n.x AS x FROM (SELECT unnest(vector) AS x, unnest(range(1, len(vector) + 1)) AS pos FROM q3) q
JOIN (SELECT pos, avg(x) AS x FROM dims WHERE id % 6 = 1 GROUP BY pos) p USING (pos)
JOIN (SELECT pos, avg(x) AS x FROM dims WHERE id % 6 = 2 GROUP BY pos) n USING (pos)""", "one")


@query("refine", "SELECT unnest(range(64)) AS pos, round(unnest(vector), 6) AS x FROM refined")
def _refine(t):
    v = t.vectors()
    q = vec.refine(v, q3(t), v.where("id % 6 = 1"), v.where("id % 6 = 2"))
    return t.spark.range(1).select(q.alias("q")).select(F.posexplode("q").alias("pos", "x")).select(F.col("pos").cast("long").alias("pos"), two_steps("x").alias("x"))


@query("like_tag", """
SELECT id, row_number() OVER (ORDER BY f DESC, id) AS place FROM (SELECT id, round(1 / (60 + row_number() OVER (ORDER BY score DESC, id))
  + coalesce(1 / (60 + krank), 0), 12) AS f FROM (SELECT w.id, round(list_dot_product(w.vector, r.vector), 9) AS score FROM wide w, refined r WHERE w.id % 6 <> 1)
  LEFT JOIN (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS krank FROM keyword_scores
    WHERE id % 6 <> 1 AND id IN (SELECT id FROM vectors)) USING (id))""")
def _like(t):
    v = t.vectors()
    keyword = materialise(keyword_scores(t), "keyword")
    return search.like_tag(v, q3(t), v.where("id % 6 = 1"), v.where("id % 6 = 2"), keyword, v.select("id")).select("id", "place")


@query("retrieval_metrics", """
WITH r AS (SELECT label AS query, id, row_number() OVER (PARTITION BY label ORDER BY (id * 7919) % 1009, id) AS rank FROM vectors),
j AS (SELECT label AS query, CASE WHEN label % 2 = 0 THEN 'keyword' ELSE 'semantic' END AS type, id FROM vectors WHERE id % 3 = 0),
p AS (SELECT j.query, j.type, count(r.id) AS hits, count(*) AS relevant FROM j LEFT JOIN r ON r.query = j.query AND r.id = j.id AND r.rank <= 10 GROUP BY 1, 2)
SELECT g AS "group", round(avg(hits / 10), 6) AS precision, round(avg(hits / relevant), 6) AS recall, count(*) AS queries
FROM (SELECT *, unnest(['overall', type]) AS g FROM p) GROUP BY g""")
def _retrieval(t):
    from pyspark.sql import Window
    v, i = t.vectors(), F.col("id")
    # Ten per query are judged, so only the first ten of each are kept.
    w = Window.partitionBy("label").orderBy(i * 7919 % 1009, "id")
    ranked = v.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select(F.col("label").alias("query"), "id", "rank")
    judged = v.where("id % 3 = 0").select(F.col("label").alias("query"), F.when(F.col("label") % 2 == 0, "keyword").otherwise("semantic")
                                          .alias("type"), "id")
    m = search.retrieval_metrics(judged, ranked)
    return m.select("group", two_steps("precision").alias("precision"), two_steps("recall").alias("recall"), "queries")


@query("check_ranking", """
SELECT key, problem FROM (
  SELECT doc_id::VARCHAR AS key, 'not a candidate' AS problem FROM documents WHERE doc_id % 50 = 0
  UNION ALL SELECT doc_id::VARCHAR, 'not a candidate' FROM documents WHERE doc_id % 50 = 0 AND doc_id % 31 = 7
  UNION ALL SELECT doc_id::VARCHAR, 'key twice' FROM documents WHERE doc_id % 31 = 7
  UNION ALL SELECT doc_id::VARCHAR, 'score not finite' FROM documents WHERE doc_id % 43 = 3
  UNION ALL SELECT doc_id::VARCHAR, 'score not finite' FROM documents WHERE doc_id % 43 = 3 AND doc_id % 31 = 7
  UNION ALL SELECT doc_id::VARCHAR, 'no text source' FROM documents WHERE doc_id % 29 = 5
  UNION ALL SELECT doc_id::VARCHAR, 'no text source' FROM documents WHERE doc_id % 29 = 5 AND doc_id % 31 = 7
  UNION ALL SELECT doc_id::VARCHAR, 'keyword rank disagrees' FROM documents WHERE doc_id % 37 = 9
  UNION ALL SELECT doc_id::VARCHAR, 'quote is not its span' FROM documents WHERE doc_id % 41 = 11 AND doc_id % 50 <> 0
  UNION ALL SELECT doc_id::VARCHAR, 'quote is not its span' FROM documents WHERE doc_id % 41 = 11 AND doc_id % 31 = 7 AND doc_id % 50 <> 0)""")
def _check(t):
    d, k = t.raw("documents"), F.col("doc_id")
    key = k.cast("string").alias("key")
    body = F.concat(F.lit("éa "), "text")
    hits = d.select(k, key, F.when(k % 43 == 3, F.lit(float("nan"))).otherwise(F.lit(0.5)).alias("score"), F.lit(3).alias("chunk_start"),
                    F.octet_length(body).alias("chunk_end"), F.when(k % 41 == 11, "other").otherwise(
                        F.substring(F.concat(F.lit(" "), "text"), 1, 200)).alias("snippet"), F.sha2(body, 256).alias("content_sha256"))
    hits = hits.unionByName(hits.where("doc_id % 31 = 7"))
    text = d.where(k % 29 != 5).select(key, F.lit("text").alias("source"), F.lit(0.1).alias("score"), (k + 1).alias("rank"))
    keyword = d.select(key, F.lit("keyword").alias("source"), F.when(k % 2 == 0, 0.0).otherwise(0.2).alias("score"),
                       F.when((k % 2 == 0) == (k % 37 != 9), 0).otherwise(k + 1).alias("rank"))
    candidates = d.where("doc_id % 50 <> 0").select(key, body.alias("body"), F.sha2(body, 256).alias("content_sha256"))
    return search.check_ranking(hits, text.unionByName(keyword), candidates)


# --- vector tables

_NEAR = """
SELECT * FROM (SELECT a.id AS "left", b.id AS "right", round(list_dot_product(a.vector, b.vector), 6) AS score, row_number() OVER (
  PARTITION BY a.id ORDER BY round(list_dot_product(a.vector, b.vector), 9) DESC, b.id)::INTEGER AS place
  FROM wide a JOIN wide b ON a.id % 5 = 0 AND b.id % 5 <> 0) WHERE place <= 7"""


@query("near_neighbours", _NEAR)
def _candidates(t):
    """Every cell is asked: the vectors lie in no clusters, and the answer is then the exact one."""
    v = t.vectors()
    return neighbours.near_neighbours(v.where("id % 5 = 0"), v.where("id % 5 <> 0"), 7, probes=neighbours.MOST_CELLS).withColumn("score", two_steps())


@query("top_k_neighbours", _NEAR)
def _neighbours(t):
    v = t.vectors()
    return vec.top_k_neighbours(v.where("id % 5 = 0"), v.where("id % 5 <> 0"), 7).withColumn("score", two_steps())


SQL_VIEWS["pooled"] = _unit("SELECT id // 3 AS id, pos, avg(x) AS x FROM dims WHERE id % 11 <> 0 GROUP BY 1, 2", "id")


@query("mean_pool", """
SELECT v.id, p.id IS NOT NULL AS from_chunks, round(coalesce(p.vector, v.vector)[1], 6) AS first, round(list_sum(coalesce(p.vector, v.vector)), 6) AS total
FROM wide v LEFT JOIN pooled p USING (id)""")
def _pool(t):
    m = vec.mean_pool(t.vectors().select("id", "vector"), chunks(t).where("id % 11 <> 0"))
    return m.select("id", "from_chunks", two_steps(F.get("vector", F.lit(0))).alias("first"),
                    two_steps(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("fuse_vectors", """
WITH p AS (SELECT a.id, a.vector AS a, b.vector AS b FROM wide a LEFT JOIN wide b ON b.id = a.id + 1 AND b.id % 4 <> 0),
f AS (SELECT id, a, b, CASE WHEN b IS NULL THEN a ELSE list_transform(range(1, 65), lambda i: a[i] + b[i]) END AS s FROM p)
SELECT id, round(s[5] / greatest(sqrt(list_dot_product(s, s)), 1e-12), 6) AS fifth, 129 AS size, (b IS NULL)::INTEGER::DOUBLE AS missing,
  round(CASE WHEN b IS NULL THEN 0 ELSE b[1] END, 6) AS second FROM f""")
def _fuse(t):
    v = t.vectors().select("id", F.col("vector").alias("a"))
    b = v.where("id % 4 <> 0").select((F.col("id") - 1).alias("id"), F.col("a").alias("b"))
    f = vec.fuse_vectors(v.join(b, "id", "left"), "a", "b")
    return f.select("id", two_steps(F.get("fused", F.lit(4))).alias("fifth"), F.size("joined").alias("size"),
                    F.get("joined", F.lit(128)).alias("missing"), two_steps(F.get("joined", F.lit(64))).alias("second"))


SQL_VIEWS["zero_scores"] = """
SELECT w.id, q.tag, w.label, CASE WHEN w.id % 3 = 0 THEN (round(list_dot_product(w.vector, q.vector), 9) + round(list_dot_product(i.vector, q.vector), 9)) / 2
  ELSE round(list_dot_product(w.vector, q.vector), 9) END AS score
FROM wide w JOIN label_queries q ON true LEFT JOIN wide i ON i.id = w.id - w.id % 2"""


def zero_scores(t: Tables):
    v = t.vectors()
    even = F.col("id") - F.col("id") % 2
    images = v.where("id % 3 = 0").select("id", even.alias("of")).join(v.select(F.col("id").alias("of"), "vector"), "of").select("id", "vector")
    return vec.zero_shot(v, label_queries(t), images)


@query("zero_shot", """
SELECT id, tag, round(score, 6) AS score, score > m + 2 * sd AS predicted FROM zero_scores JOIN
  (SELECT tag, avg(score) AS m, stddev_pop(score) AS sd FROM zero_scores GROUP BY tag) USING (tag)""")
def _zero(t):
    return zero_scores(t).withColumn("score", two_steps())


@query("prototype_queries", """
SELECT tag, round(vector[1], 6) AS first, round(list_sum(vector), 6) AS total FROM
 (SELECT q.tag, CASE WHEN p.vector IS NULL THEN q.vector ELSE p.vector END AS vector FROM label_queries q LEFT JOIN positives p USING (tag))""")
def _proto(t):
    v = t.vectors()
    labels = v.where("id % 2 = 1 and label < 7").select("id", F.col("label").alias("tag"))
    p = vec.prototype_queries(v, labels, label_queries(t))
    return p.select("tag", two_steps(F.get("vector", F.lit(0))).alias("first"),
                    two_steps(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)).alias("total"))


SQL_VIEWS["positives"] = _unit("SELECT label AS tag, pos, avg(x) AS x FROM dims WHERE id % 2 = 1 AND label < 7 GROUP BY 1, 2", "tag")


@query("reconcile_vectors", """
WITH w AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'new' ELSE 'old' END AS hash, id % 13 = 0 AS masked FROM vectors WHERE id % 7 <> 0),
s AS (SELECT id, 'old' AS hash, CASE WHEN id % 11 = 0 THEN 'm0' ELSE 'm1' END AS model FROM vectors WHERE id % 3 <> 0)
SELECT id, CASE WHEN w.id IS NULL THEN CASE WHEN model = 'm1' THEN 'retained' ELSE 'dropped' END WHEN masked THEN 'masked'
  WHEN model = 'm1' AND w.hash = s.hash THEN 'reused' WHEN s.id IS NOT NULL THEN 'stale' ELSE 'missing' END AS status
FROM w FULL JOIN s USING (id)""")
def _reconcile(t):
    i, v = F.col("id"), t.vectors()
    wanted = v.where("id % 7 <> 0").select("id", F.when(i % 5 == 0, "new").otherwise("old").alias("hash"), (i % 13 == 0).alias("masked"))
    stored = v.where("id % 3 <> 0").select("id", F.lit("old").alias("hash"), F.when(i % 11 == 0, "m0").otherwise("m1").alias("model"), "vector")
    return vec.reconcile_vectors(wanted, stored, F.lit("m1"), retain=True).select("id", "status")


@query("embed_text", """
SELECT doc_id, sha256('title: ' || CASE WHEN doc_id % 3 = 0 THEN 'none' ELSE source END || ' | text: ' || replace(text || '<|image|>', '<|image|>', '< |image|>')) AS doc
FROM documents""")
def _embed_text(t):
    d = t.raw("documents")
    title = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source"))
    return d.select("doc_id", F.sha2(vec.embed_text(title, F.concat("text", F.lit("<|image|>"))), 256).alias("doc"))


@query("embed_documents")
def _embed(t):

    @F.pandas_udf("array<float>")
    def counts(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [float(len(x)), float(x.count(" "))])

    d = t.raw("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), "text")
    return vec.embed_documents(d, counts)
