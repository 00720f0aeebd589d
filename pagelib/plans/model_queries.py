"""Tag models and their evaluation over the embeddings, whose label is the tag."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelib.operators import evaluate, models
from pagelib.operators import vectors as vec
from pagelib.plans.registry import query
from pagelib.plans.search_queries import label_queries, q3, two_steps
from pagelib.plans.tables import SQL_VIEWS, Tables
from pagelib.session import materialise

# Every page scored against every label query: y where the label is the page's own.
SQL_VIEWS["cells"] = """
SELECT w.id, q.tag, round(list_dot_product(w.vector, q.vector), 9) AS score, (w.label = q.tag)::INTEGER AS y,
  round(list_dot_product(w.vector, q.vector), 9) > 0.2 AS pred FROM wide w, label_queries q"""


def cells(t: Tables):
    v = t.vectors()
    s = vec.blocked_products(v.select("id", "vector"), label_queries(t).select(F.col("tag").alias("id"), "vector"))
    s = s.select(F.col("left").alias("id"), F.col("right").alias("tag"), "score").join(v.select("id", "label"), "id")
    out = s.select("id", "tag", "score", (F.col("label") == F.col("tag")).cast("int").alias("y"), (F.col("score") > 0.2).alias("pred"))
    return materialise(out, "cells")


SQL_VIEWS["curve"] = """
SELECT tag, score, sum(n) OVER w AS predicted, sum(pos) OVER w AS tp, pos, sum(pos) OVER (PARTITION BY tag) AS positives FROM
  (SELECT tag, score, count(*) AS n, sum(y) AS pos FROM cells GROUP BY 1, 2) WINDOW w AS (PARTITION BY tag ORDER BY score DESC)"""
SQL_VIEWS["tag_ap"] = "SELECT tag, sum(pos * tp / predicted) / max(positives) AS ap FROM curve GROUP BY tag HAVING max(positives) > 0"


@query("cumulative_precision_recall", "SELECT tag, round(score, 6) AS score, predicted::BIGINT AS predicted, tp::BIGINT AS tp FROM curve")
def _curve(t):
    return evaluate.cumulative_precision_recall(cells(t), ["tag"]).select("tag", two_steps().alias("score"), "predicted", "tp")


@query("average_precision", "SELECT tag, round(ap, 6) AS ap FROM tag_ap")
def _ap(t):
    return evaluate.average_precision(cells(t), ["tag"]).withColumn("ap", two_steps("ap"))


@query("best_threshold", """
SELECT tag, round(-f[2], 6) AS threshold, round(f[1], 6) AS f1 FROM (SELECT tag, max((2 * tp / (predicted + positives), -score)) AS f FROM curve GROUP BY tag)""")
def _threshold(t):
    return evaluate.best_threshold(cells(t), ["tag"]).select("tag", two_steps("threshold").alias("threshold"), two_steps("f1").alias("f1"))


SQL_VIEWS["tag_scores"] = """
SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
  CASE WHEN predicted + support > 0 THEN 2 * tp / (predicted + support) ELSE 0 END AS f1 FROM (SELECT tag, count(*) FILTER (y = 1 AND pred) AS tp,
  count(*) FILTER (y = 1) AS support, count(*) FILTER (pred) AS predicted FROM cells GROUP BY tag) LEFT JOIN tag_ap USING (tag)"""


@query("tag_metrics", """
SELECT tag, tp, support, predicted, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(ap, 6) AS ap FROM tag_scores""")
def _metrics(t):
    m = evaluate.tag_metrics(cells(t))
    return m.withColumns({c: two_steps(c) for c in ("precision", "recall", "f1", "ap")})


@query("summary_metrics", """
WITH m AS (SELECT count(*) FILTER (y = 1 AND pred) AS tp, count(*) FILTER (y = 1) AS support, count(*) FILTER (pred) AS predicted FROM cells),
c AS (SELECT sum(n) OVER (ORDER BY score DESC) AS predicted, sum(pos) OVER (ORDER BY score DESC) AS tp, pos FROM
  (SELECT score, count(*) AS n, sum(y) AS pos FROM cells GROUP BY 1))
SELECT 'macro' AS level, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, round(avg(ap), 6) AS ap FROM tag_scores
UNION ALL SELECT 'micro', round(tp / predicted, 6), round(tp / support, 6), round(2 * tp / (predicted + support), 6),
  (SELECT round(sum(pos * tp / predicted) / sum(pos), 6) FROM c) FROM m""")
def _summary(t):
    c = cells(t)
    s = evaluate.summary_metrics(c, evaluate.tag_metrics(c))
    return s.withColumns({x: two_steps(x) for x in ("precision", "recall", "f1", "ap")})


# Labels of a page: its own, and one shared by a third of the pages.
SQL_VIEWS["labels_of"] = """
SELECT id, label AS tag FROM vectors WHERE id % 4 <> 0 UNION SELECT id, 100 FROM vectors WHERE id % 3 = 0 UNION SELECT id, 7 FROM vectors WHERE id % 11 = 0"""


def labels_of(t: Tables):
    v = t.vectors()
    return (v.where("id % 4 <> 0").select("id", F.col("label").alias("tag")).union(v.where("id % 3 = 0").select("id", F.lit(100)))
            .union(v.where("id % 11 = 0").select("id", F.lit(7))).distinct())


SQL_VIEWS["folds"] = """
SELECT id, (row_number() OVER (PARTITION BY stratum ORDER BY sha256('0:' || id), id) - 1) % 5 AS fold FROM (
  SELECT id, arg_min(tag, (n, tag)) AS stratum FROM labels_of JOIN (SELECT tag, count(*) AS n FROM labels_of GROUP BY tag) USING (tag) GROUP BY id)"""


@query("stratified_folds", "SELECT id, fold FROM folds")
def _folds(t):
    return evaluate.stratified_folds(labels_of(t))


@query("fit_prior", "SELECT tag, round(count(*) / (SELECT count(*) FROM vectors), 6) AS score FROM labels_of GROUP BY tag")
def _prior(t):
    return models.fit_prior(labels_of(t), t.vectors()).withColumn("score", two_steps())


SQL_VIEWS["near"] = """
SELECT * FROM (SELECT a.id AS test, b.id AS train, greatest(round(list_dot_product(a.vector, b.vector), 9), 0) + 1e-6 AS w, row_number() OVER (
  PARTITION BY a.id ORDER BY round(list_dot_product(a.vector, b.vector), 9) DESC, b.id) AS place FROM wide a JOIN wide b ON a.id % 5 = 0 AND b.id % 5 <> 0)
WHERE place <= 10"""


@query("knn_scores", """
SELECT test AS id, tag, round(sum(w) / any_value(total), 6) AS score FROM near JOIN labels_of ON id = train
JOIN (SELECT test, sum(w) AS total FROM near GROUP BY test) USING (test) GROUP BY 1, 2""")
def _knn(t):
    v = t.vectors()
    s = models.knn_scores(v.where("id % 5 = 0"), v.where("id % 5 <> 0"), labels_of(t), 10)
    return s.withColumn("score", two_steps())


@query("fit_knn")
def _fit_knn(t):
    return models.fit_knn(t.vectors(), labels_of(t), [5, 10, 20, 40, 80])


@query("fit_tag_heads")
def _heads(t):
    v = t.vectors()
    labels = v.select("id", F.col("label").alias("tag"))
    scores, rules = models.fit_tag_heads(v, labels, v)
    return scores.groupBy("tag").agg(F.count(F.lit(1)).alias("pages"), F.avg("score").alias("mean")).join(rules, "tag")


def real_heads(train, labels, apply_to):
    """Logistic heads fitted on the rows of a fold."""
    return models.fit_tag_heads(train, labels, apply_to)[0]


@query("cross_validate")
def _cross(t):
    v = t.vectors()
    labels = v.select("id", F.col("label").alias("tag"))
    folds = materialise(evaluate.stratified_folds(labels), "folds")

    def fit_and_score(train, test):
        return real_heads(train.select("id", "vector"), labels.join(train.select("id"), "id", "left_semi"), test.select("id", "vector"))

    s = evaluate.cross_validate(v.select("id", "vector"), folds, 5, fit_and_score)
    rows = s.join(v.select("id", "label"), "id").select("tag", "score", (F.col("label") == F.col("tag")).cast("int").alias("y"),
                                                       (F.col("score") > 0.2).alias("pred"))
    return evaluate.tag_metrics(materialise(rows, "pooled"))


@query("page_predictions")
def _predictions(t):
    v = t.vectors()
    labels = v.where("id % 3 <> 0").select("id", F.col("label").alias("tag"))
    folds = materialise(evaluate.stratified_folds(labels, 3), "folds")
    p = models.page_predictions(v.select("id", "vector"), labels, folds, 3, real_heads)
    return p.groupBy("tag", "origin").agg(F.count(F.lit(1)).alias("cells"), F.avg("score").alias("mean"))


@query("blended_scores")
def _blended(t):
    v = t.vectors()
    answers = v.where("id % 5 = 0").select("id", (F.col("label") == 3).cast("int").alias("y"))
    return models.blended_scores(v.select("id", "vector"), q3(t), answers)


SQL_VIEWS["spread"] = "SELECT tag, avg(score) AS m, greatest(stddev_pop(score), 1e-12) AS sd FROM cells GROUP BY tag"


@query("suggest_tags", """
SELECT tag, round(z, 6) AS z FROM (SELECT tag, round((avg(score) - any_value(m)) / any_value(sd), 9) AS z FROM cells JOIN spread USING (tag)
  WHERE id % 10 = 4 AND tag <> 2 GROUP BY tag ORDER BY z DESC, tag LIMIT 8)""")
def _suggest(t):
    c = cells(t)
    active = c.select("tag").distinct().where("tag <> 2")
    return models.suggest_tags(c, t.vectors().where("id % 10 = 4"), active).withColumn("z", two_steps("z"))


@query("precheck", """
SELECT id, tag, score >= 0.1 + 0.5 * sd AS checked, round(1 / (1 + exp(-(score - (0.1 + 0.5 * sd)) / sd)), 6) AS p FROM cells JOIN spread USING (tag) WHERE y = 0""")
def _precheck(t):
    c = cells(t)
    rules = c.select("tag").distinct().withColumn("threshold", F.lit(0.1))
    return models.precheck(c, rules, c.where("y = 1").select("id", "tag"), 0.5).withColumn("p", two_steps("p"))


_RANK = "row_number() OVER (PARTITION BY id ORDER BY part, z DESC, tag)::INTEGER AS place"
SQL_VIEWS["z_cells"] = "SELECT id, tag, score, tag % 2 = 0 AS head, y, 0 AS part, round((score - m) / sd, 9) AS z FROM cells JOIN spread USING (tag)"
_STRATEGY = {"app": "SELECT * FROM z_cells", "heads_only": "SELECT * FROM z_cells WHERE head",
             "heads_first": "SELECT * REPLACE (CASE WHEN head THEN 0 ELSE 1 END AS part) FROM z_cells WHERE NOT head OR score >= 0.15",
             "margin": "SELECT * REPLACE (round(score - 0.15, 9) AS z) FROM z_cells"}


def head_rules(c):
    return c.select("tag").distinct().select("tag", F.lit(0.15).alias("threshold"), (F.col("tag") % 2 == 0).alias("head"))


def _strategy(name: str, sql: str):
    @query(f"rank_strategy_{name}", f"SELECT id, tag, round(z, 6) AS z, {_RANK} FROM ({sql})")
    def run(t):
        c = cells(t)
        return models.STRATEGIES[name](c.select("id", "tag", "score"), head_rules(c)).withColumn("z", two_steps("z"))


for _name, _sql in _STRATEGY.items():
    _strategy(_name, _sql)

SQL_VIEWS["app_ranked"] = f"SELECT id, tag, z, {_RANK} FROM z_cells"
SQL_VIEWS["at_three"] = """
SELECT g, coalesce(t.id, p.id) AS id, coalesce(t.tag, p.tag) AS tag, t.id IS NOT NULL AS y, p.id IS NOT NULL AS p FROM
  (SELECT id, tag, 'overall' AS g FROM cells WHERE y = 1 UNION ALL SELECT id, tag, CASE WHEN tag % 2 = 0 THEN 'head' ELSE 'fallback' END FROM cells WHERE y = 1) t
FULL JOIN (SELECT id, tag, unnest(['overall', CASE WHEN tag % 2 = 0 THEN 'head' ELSE 'fallback' END]) AS g FROM app_ranked WHERE place <= 3) p USING (g, id, tag)"""


def _measure(source: str) -> str:
    return f"""
SELECT "group", round(page_precision, 6) AS page_precision, round(page_recall, 6) AS page_recall, round(hit, 6) AS hit, tp::BIGINT AS tp, positives::BIGINT AS positives,
  predictions::BIGINT AS predictions, round(tp / greatest(predictions, 1), 6) AS micro_precision, round(tp / positives, 6) AS micro_recall,
  round(tag_precision, 6) AS tag_precision, round(tag_recall, 6) AS tag_recall FROM
 (SELECT g AS "group", avg(CASE WHEN pred > 0 THEN tp / pred END) AS page_precision, avg(CASE WHEN pos > 0 THEN tp / pos END) AS page_recall,
    avg(CASE WHEN pos > 0 THEN (tp > 0)::INTEGER END) AS hit, sum(tp) AS tp, sum(pos) AS positives, sum(pred) AS predictions FROM
    (SELECT g, id, count(*) FILTER (y AND p) AS tp, count(*) FILTER (y) AS pos, count(*) FILTER (p) AS pred FROM {source} GROUP BY 1, 2) GROUP BY g)
 JOIN (SELECT g AS "group", avg(CASE WHEN pred > 0 THEN tp / pred ELSE 0 END) AS tag_precision, avg(CASE WHEN pos > 0 THEN tp / pos ELSE 0 END) AS tag_recall FROM
    (SELECT g, tag, count(*) FILTER (y AND p) AS tp, count(*) FILTER (y) AS pos, count(*) FILTER (p) AS pred FROM {source} GROUP BY 1, 2) GROUP BY g) USING ("group")"""


def rounded(df):
    return df.select(*[two_steps(c).alias(c) if d == "double" else F.col(c) for c, d in df.dtypes])


def _with_group(df):
    return df.withColumn("kind", F.when(F.col("tag") % 2 == 0, "head").otherwise("fallback"))


@query("precision_recall_hit_at_3", _measure("at_three"))
def _at3(t):
    c = cells(t)
    ranked = materialise(models.rank_strategies(c.select("id", "tag", "score"), head_rules(c), "app").where("place <= 3"), "ranked")
    truth = c.where("y = 1").select("id", "tag")
    overall = evaluate.precision_recall_hit_at_3(truth, ranked)
    sliced = evaluate.precision_recall_hit_at_3(_with_group(truth), _with_group(ranked), "kind")
    return rounded(overall.unionByName(sliced))


@query("choose_cut", """
WITH s AS (SELECT z AS score FROM app_ranked WHERE place <= 3), c AS (SELECT score, (SELECT count(*) FROM s x WHERE x.score >= d.score) AS shown
  FROM (SELECT DISTINCT score FROM s) d UNION ALL SELECT 'inf'::DOUBLE, 0),
g AS (SELECT score, shown / (SELECT count(*) FROM vectors) AS per_page FROM c)
SELECT round(score, 6) AS cut, round(per_page, 6) AS shown_per_page FROM g ORDER BY abs(per_page - 1.5), score DESC LIMIT 1""")
def _cut(t):
    c = cells(t)
    ranked = materialise(models.rank_strategies(c.select("id", "tag", "score"), head_rules(c), "app").where("place <= 3"), "ranked")
    return rounded(evaluate.choose_cut(ranked.select(F.col("z").alias("score")), t.vectors().agg(F.count(F.lit(1))).scalar(), 1.5))


SQL_VIEWS["abstained"] = """
SELECT c.target AS g, coalesce(t.id, p.id) AS id, coalesce(t.tag, p.tag) AS tag, t.id IS NOT NULL AS y, p.id IS NOT NULL AS p FROM
  (SELECT id, tag, unnest(['1.0', '2.0']) AS target FROM cells WHERE y = 1) t FULL JOIN (SELECT id, tag, target FROM
  (SELECT *, unnest(['1.0', '2.0']) AS target, unnest([1.1, 0.2]) AS cut FROM app_ranked WHERE place <= 3) WHERE z >= cut) p USING (id, tag, target)
  JOIN (SELECT unnest(['1.0', '2.0']) AS target) c ON c.target = coalesce(t.target, p.target)"""


@query("abstention_curve", f"""
SELECT m.* EXCLUDE ("group"), "group" AS target, round(shown / n, 6) AS shown_per_page, round(1 - pages / n, 6) AS none_shown_share FROM ({_measure('abstained')}) m
JOIN (SELECT g AS "group", count(*) FILTER (p) AS shown, count(DISTINCT id) FILTER (p) AS pages, (SELECT count(*) FROM vectors) AS n FROM abstained GROUP BY g) USING ("group")""")
def _abstain(t):
    c = cells(t)
    ranked = models.rank_strategies(c.select("id", "tag", "score"), head_rules(c), "app").where("place <= 3")
    ranked = materialise(ranked.withColumnRenamed("z", "score"), "ranked")
    n = t.vectors().agg(F.count(F.lit(1))).scalar()
    return rounded(evaluate.abstention_curve(c.where("y = 1").select("id", "tag"), ranked, {1.0: 1.1, 2.0: 0.2}, n))


@query("paired_runs", """
SELECT id, CASE WHEN id % 10 = 0 THEN 'missing in candidate' WHEN id % 11 = 0 THEN 'missing in baseline' WHEN id % 7 = 0 AND id % 5 <> 0 THEN 'fold differs'
  WHEN id % 13 = 0 THEN 'truth differs' END AS problem FROM vectors WHERE NOT (id % 10 = 0 AND id % 11 = 0) AND problem IS NOT NULL""")
def _paired(t):
    i, v = F.col("id"), t.vectors()
    a = v.where("id % 10 <> 0").select("id", (i % 5).alias("fold"), F.lit("x").alias("truth"))
    b = v.where("id % 11 <> 0").select("id", F.when((i % 7 == 0) & (i % 5 != 0), 0).otherwise(i % 5).alias("fold"),
                                      F.when(i % 13 == 0, "y").otherwise("x").alias("truth"))
    return evaluate.paired_runs(a, b)


@query("paired_bootstrap")
def _bootstrap(t):
    c = cells(t)
    hit = c.groupBy("id").agg(F.max(F.when((F.col("y") == 1) & F.col("pred"), 1.0).otherwise(0.0)).alias("a"),
                              F.max(F.when((F.col("y") == 1) & (F.col("score") > 0.5), 1.0).otherwise(0.0)).alias("b"))
    return evaluate.paired_bootstrap(hit)


@query("compare_runs", """
WITH j AS (SELECT a.path AS pa, b.path AS pb, x, y FROM (SELECT 'm/' || doc_id || CASE WHEN doc_id % 9 = 0 THEN '_ms' ELSE '' END AS path, n_chars::DOUBLE AS x FROM documents
  WHERE doc_id % 10 <> 1) a FULL JOIN (SELECT 'm/' || doc_id || CASE WHEN doc_id % 9 = 0 THEN '_ms' ELSE '' END AS path, n_chars + CASE WHEN doc_id % 4 = 0 THEN doc_id / 1000000 ELSE 0 END AS y
  FROM documents WHERE doc_id % 10 <> 2) b ON a.path = b.path WHERE coalesce(a.path, b.path) NOT LIKE '%#_ms' ESCAPE '#')
SELECT count(*) AS compared, count(*) FILTER (pa IS NULL OR pb IS NULL OR abs(x - y) > 1e-4) AS differing, round(max(abs(x - y)), 6) AS largest_gap,
  arg_max(pa, (round(abs(x - y), 9), pa)) FILTER (x IS NOT NULL AND y IS NOT NULL) AS largest_gap_at FROM j""")
def _compare(t):
    d, k = t.raw("documents"), F.col("doc_id")
    path = F.concat(F.lit("m/"), k.cast("string"), F.when(k % 9 == 0, "_ms").otherwise("")).alias("path")
    a = d.where(k % 10 != 1).select(path, F.col("n_chars").cast("double").alias("value"))
    b = d.where(k % 10 != 2).select(path, (F.col("n_chars") + F.when(k % 4 == 0, k / 1000000).otherwise(0.0)).alias("value"))
    return rounded(evaluate.compare_runs(a, b, 1e-4))


# --- clusters: by a formula, so the reports can be checked exactly

SQL_VIEWS["assigned"] = "SELECT id, ((label * 3 + id % 4) % 7)::INTEGER AS cluster FROM vectors"
SQL_VIEWS["overlap"] = """
SELECT cluster, tag, shared, size, holders FROM (SELECT cluster, tag, count(*) AS shared FROM assigned JOIN labels_of USING (id) GROUP BY 1, 2)
JOIN (SELECT cluster, count(*) AS size FROM assigned GROUP BY 1) USING (cluster) JOIN (SELECT tag, count(*) AS holders FROM labels_of GROUP BY 1) USING (tag)"""


def assigned(t: Tables):
    return t.vectors().select("id", ((F.col("label") * 3 + F.col("id") % 4) % 7).cast("int").alias("cluster"))


@query("jaccard", "SELECT cluster, tag, round(shared / (size + holders - shared), 6) AS jaccard FROM overlap")
def _jaccard(t):
    return models.jaccard(assigned(t), labels_of(t)).select("cluster", "tag", two_steps("jaccard").alias("jaccard"))


@query("cluster_report", """
SELECT cluster, max(size) AS size, arg_min(tag, (-round(shared / (size + holders - shared), 12), tag)) AS best_tag, round(max(shared / (size + holders - shared)), 6) AS jaccard,
  round(max(shared) / max(size), 6) AS purity, max(round(shared / (size + holders - shared), 12)) >= 0.1 AS matched FROM overlap GROUP BY cluster""")
def _clusters(t):
    return rounded(models.cluster_report(assigned(t), labels_of(t)))


@query("tag_split_report", """
SELECT tag, max(holders) AS positives, arg_min(cluster, (-round(2 * shared / (size + holders), 12), cluster)) AS best_cluster, round(max(2 * shared / (size + holders)), 6) AS best_cluster_f1,
  round(max(shared / holders), 6) AS largest_share, count(*) FILTER (shared / holders >= 0.1) AS clusters_with_10pct, max(shared / holders) < 0.5 AS split FROM overlap GROUP BY tag""")
def _split(t):
    return rounded(models.tag_split_report(assigned(t), labels_of(t)))


@query("cluster_terms", """
WITH t AS (SELECT (doc_id % 7)::INTEGER AS cluster, unnest(list_concat(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9+#]{2,}'), lambda w: w NOT IN ('the', 'and')), [source])) AS term FROM documents),
n AS (SELECT cluster, term, count(*) AS n FROM t GROUP BY 1, 2), a AS (SELECT term, sum(n) AS total FROM n GROUP BY term HAVING count(*) >= 2),
f AS (SELECT n.*, total, sum(n) OVER (PARTITION BY cluster) AS words FROM n JOIN a USING (term)),
w AS (SELECT cluster, term, round(n / words * ln(1 + (SELECT sum(n) FROM f) / 7 / total), 12) AS weight FROM f)
SELECT cluster, term, round(weight, 6) AS weight, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, term) AS place FROM w) WHERE place <= 5""")
def _terms(t):
    d = t.raw("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"), F.col("source").alias("host"))
    assign = d.select("id", (F.col("id") % 7).cast("int").alias("cluster"))
    return rounded(models.cluster_terms(assign, d, ["the", "and"]))


@query("cluster_pages")
def _kmeans(t):
    a = models.cluster_pages(t.vectors().select("id", "vector"), 10)
    return models.cluster_report(a, labels_of(t))


@query("silhouette_curve")
def _silhouette(t):
    return models.silhouette_curve(t.vectors().select("id", "vector"), list(range(10, 61, 5)))


@query("decide_in_set", """
WITH s AS (SELECT id, tag, score, row_number() OVER (PARTITION BY tag ORDER BY score DESC, id) AS place FROM cells WHERE id % 6 = 1 AND tag % 3 = 0)
SELECT id, tag, place <= greatest(1, round_even((tag + 1) / 40 * (SELECT count(DISTINCT id) FROM s), 0)) AS applied FROM s""")
def _decide(t):
    c = cells(t).where("id % 6 = 1").select("id", "tag", "score")
    picked = c.select("tag").distinct().where("tag % 3 = 0").withColumn("rate", (F.col("tag") + 1) / 40)
    return models.decide_in_set(c, picked)


@query("pick_rates", """
WITH h AS (SELECT id % 17 AS s, tag, count(*) AS h FROM vectors JOIN labels_of USING (id) GROUP BY 1, 2),
r AS (SELECT tag, h / n AS share FROM h JOIN (SELECT id % 17 AS s, count(*) AS n FROM vectors GROUP BY 1) USING (s) WHERE h >= 3)
SELECT tag, round(coalesce(m, (SELECT median(share) FROM r)), 6) AS rate FROM (SELECT DISTINCT tag FROM labels_of UNION SELECT 999) LEFT JOIN (SELECT tag, median(share) AS m FROM r GROUP BY tag) USING (tag)""")
def _rates(t):
    v, lab = t.vectors(), labels_of(t)
    sets = v.select((F.col("id") % 17).alias("set"), "id")
    every = lab.select("tag").distinct().union(t.spark.range(1).select(F.lit(999)))
    return rounded(models.pick_rates(sets, lab, every))


# --- page records and their summary

SQL_VIEWS["records"] = """
SELECT p.url, p.domain AS host, p.title, p.url IN (SELECT url FROM forgotten) AS forgotten, coalesce(n, 0) AS tags,
  coalesce(l.status = 'ok' AND l.content_sha256 IS NOT NULL, false) AS text_ok, coalesce(page_id % 3 = 0, false) AS image_ok, page_id % 6 <> 0 AS has_metadata
FROM lib_pages p JOIN pages USING (url) LEFT JOIN latest_content l USING (url) LEFT JOIN (SELECT url, count(*) AS n FROM shown GROUP BY url) USING (url)"""


def records(t: Tables):
    from pagelib.operators import library as lib
    from pagelib.operators import logs, tags
    pages = lib.library_pages(t.sightings(), t.forgotten(), shape="serve")
    shown = tags.shown_tags(t.page_tags(), t.vocabulary())
    p = t.raw("pages").select("page_id", "url")
    images = p.where("page_id % 3 = 0").select("url", F.lit("ok").alias("status"), F.lit(True).alias("kept"))
    meta = p.where("page_id % 6 <> 0").select("url", F.lit("d").alias("lines"))
    return lib.page_records(pages, shown, logs.latest_by_key(t.content_log()), images, meta)


@query("page_records", "SELECT url, host, title, forgotten, tags, tags > 0 AS labelled, text_ok, image_ok, has_metadata FROM records")
def _records(t):
    return records(t).select("url", "host", "title", "forgotten", "tags", "labelled", "text_ok", "image_ok", "has_metadata")


@query("dataset_summary", """
SELECT count(*) AS known_pages, count(*) FILTER (tags > 0) AS labelled_pages, count(*) FILTER (tags = 0) AS unlabelled_pages, sum(tags)::BIGINT AS associations,
  (SELECT count(*) FROM (SELECT tag FROM shown GROUP BY tag HAVING count(*) >= 10)) AS trained_tags, count(*) FILTER (tags > 0 AND text_ok) AS labelled_text_ok,
  count(*) FILTER (tags > 0 AND image_ok) AS labelled_image_ok, count(*) FILTER (tags > 0 AND text_ok AND image_ok) AS labelled_both_ok,
  count(*) FILTER (tags > 0 AND has_metadata) AS labelled_with_metadata FROM records""")
def _dataset(t):
    from pagelib.operators import library as lib
    from pagelib.operators import tags
    return lib.dataset_summary(records(t), tags.shown_tags(t.page_tags(), t.vocabulary()))
