"""Tag models: heads, neighbours, priors, clusters, and what they suggest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from pagelib.functions import heads, vectors as V
from pagelib.functions import ordered
from pagelib.functions.ordered import Coarse
from pagelib.operators.evaluate import average_precision, best_threshold, stratified_folds
from pagelib.operators.vectors import blocked_products, top_k_neighbours
from pagelib.session import materialise

MIN_POSITIVES = 10
TRAIN_ROWS = 20_000   # labelled rows that heads are fitted on, about, beside those that rare tags need
TAG_ROWS = 50         # positives of each tag that are kept at least, about; a tag with fewer keeps all
SUGGEST = 8
NO_MATCH_JACCARD = 0.1
NEIGHBOURS = [5, 10, 20, 40, 80]


# --- heads

def _features(vectors: DataFrame) -> DataFrame:
    return vectors.select("id", array_to_vector(V.doubles("vector")).alias("raw"))


def _fit(data: DataFrame, n: int, c: float):
    """One balanced logistic regression; `data` has (features, label, weight)."""
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=50,
                            regParam=1.0 / (c * max(n, 1)), standardization=False)
    return lr.fit(data)


def _decisions(model, scaled: DataFrame, tag) -> DataFrame:
    margin = F.get(vector_to_array("rawPrediction"), F.lit(1))
    return model.transform(scaled).select("id", F.lit(tag).alias("tag"), margin.alias("score"))


def fit_tag_heads(vectors: DataFrame, labels: DataFrame, apply_to: DataFrame, cs: list[float] = (0.001, 0.01, 0.1),
                  inner: int = 3, train_rows: int = TRAIN_ROWS, k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(scores, rules): a balanced logistic head per tag with ten positives or more.

    Positives are counted over all labels. Only labelled rows are fitted; of more than `train_rows` a share is chosen by
    hash, larger for rows with rare tags, so that each tag keeps about TAG_ROWS positives, or all it has, at any size; a
    row counts in the fit as the inverse of its share. Their vectors are broadcast once (about (train_rows + tags *
    TAG_ROWS) * dimensions numbers at most), tags are dealt over tasks, and each task standardises, balances and
    penalises inside the rows of its fit. C is chosen by out-of-fold average precision and the threshold by out-of-fold
    F1. The heads score all rows of `apply_to` in one blocked product; with `k`, only a row's `k` best tags and those above
    their threshold leave it.
    """
    spark = vectors.sparkSession
    lab = labels.select("id", "tag").distinct()
    n = lab.select("id").distinct().count()
    every = train_rows / max(n, 1)
    counts = lab.groupBy("tag").agg(F.count(F.lit(1)).alias("positives"))
    share = F.least(F.lit(1.0), F.greatest(F.lit(every), F.max(F.lit(TAG_ROWS) / F.col("positives"))))
    chosen = lab.join(counts, "tag").groupBy("id").agg(share.alias("share"))
    lot = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 40)) / F.lit(1 << 40)
    chosen = materialise(chosen.where(lot < F.col("share")), "chosen")
    lab = materialise(lab.join(chosen, "id").join(counts, "tag"), "labels")
    folds = materialise(stratified_folds(lab.select("id", "tag"), inner), "folds")
    sample = vectors.join(folds, "id").join(chosen, "id").select("id", "fold", "share", V.doubles("vector").alias("vector")).orderBy("id").toPandas()
    shared = spark.sparkContext.broadcast((
        np.array(sample["vector"].tolist(), dtype=np.float64), sample["fold"].to_numpy(), {k: i for i, k in enumerate(sample["id"].tolist())},
        1 / sample["share"].to_numpy()))
    kind = labels.schema["tag"].dataType.simpleString()

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, fold, row, rows = shared.value
        for batch in batches:
            fitted = []
            for ids in batch["ids"]:
                y = np.zeros(len(x))
                y[[row[k] for k in ids if k in row]] = 1
                fitted.append(heads.choose_and_fit(x, y, fold, list(cs), rows))
            c, threshold, ap, vector = zip(*fitted) if fitted else ((), (), (), ())
            yield pd.DataFrame({"tag": batch["tag"], "c": c, "threshold": threshold, "ap": ap, "vector": list(vector)})

    held = lab.where(F.col("positives") >= MIN_POSITIVES).groupBy("tag").agg(F.collect_list("id").alias("ids"))
    tags = max(1, held.count())
    rules = materialise(held.repartition(min(tags, spark.sparkContext.defaultParallelism * 4), "tag")
                        .mapInPandas(fit, f"tag {kind}, c double, threshold double, ap double, vector array<double>"), "rules")
    with_one = apply_to.select("id", F.concat(V.doubles("vector"), F.array(F.lit(1.0))).alias("vector"))
    floor = [] if k is None else [F.col("threshold").alias("floor")]
    scores = blocked_products(with_one, rules.select(F.col("tag").alias("id"), "vector", *floor), k)
    return scores.select(F.col("left").alias("id"), F.col("right").alias("tag"), "score"), rules.drop("vector")


def fit_prior(labels: DataFrame, pages: DataFrame) -> DataFrame:
    """(tag, score): the share of pages that hold each tag, the same for every page."""
    n = pages.agg(F.count(F.lit(1))).scalar()
    return labels.groupBy("tag").agg((F.countDistinct("id") / n).alias("score"))


def knn_scores(test: DataFrame, train: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(id, tag, score): similarity-weighted share of the k nearest training rows that hold the tag."""
    near = top_k_neighbours(test, train, k).withColumn("w", F.greatest(F.col("score"), F.lit(0.0)) + 1e-6)
    total = near.groupBy("left").agg(F.sum("w").alias("total"))
    held = near.join(labels.select(F.col("id").alias("right"), "tag").distinct(), "right").groupBy("left", "tag").agg(F.sum("w").alias("w"))
    return held.join(total, "left").select(F.col("left").alias("id"), "tag", (F.col("w") / F.col("total")).alias("score"))


def fit_knn(vectors: DataFrame, labels: DataFrame, ks: list[int] = NEIGHBOURS, inner: int = 3) -> DataFrame:
    """(k, macro_ap) of each candidate k by inner folds, best first."""
    folds = materialise(stratified_folds(labels, inner), "folds")
    v = vectors.join(folds, "id")
    near = None
    for i in range(inner):
        part = top_k_neighbours(v.where(F.col("fold") == i).select("id", "vector"), v.where(F.col("fold") != i).select("id", "vector"), max(ks))
        near = part if near is None else near.unionByName(part)
    near = materialise(near.withColumn("w", F.greatest(F.col("score"), F.lit(0.0)) + 1e-6), "near")
    near = near.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.col("place") <= F.col("k"))
    total = near.groupBy("k", "left").agg(F.sum("w").alias("total"))
    lab = labels.select("id", "tag").distinct()
    held = near.join(lab.withColumnRenamed("id", "right"), "right").groupBy("k", "left", "tag").agg(F.sum("w").alias("w"))
    s = held.join(total, ["k", "left"]).select("k", F.col("left").alias("id"), "tag", F.round(F.col("w") / F.col("total"), 9).alias("score"))
    y = lab.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).withColumn("y", F.lit(1))
    # Pages no neighbour gives the tag score 0: positives among them still count as missed.
    cells = s.join(y, ["k", "id", "tag"], "full_outer").na.fill({"score": 0.0, "y": 0})
    ap = average_precision(cells, ["k", "tag"])
    return ap.groupBy("k").agg(F.avg("ap").alias("macro_ap")).orderBy(F.desc("macro_ap"), "k")


# --- using scores

def tag_spread(scores: DataFrame) -> DataFrame:
    """(tag, mean, sd) of every tag's score over the library."""
    return scores.groupBy("tag").agg(F.avg("score").alias("mean"), F.greatest(F.stddev_pop("score"), F.lit(1e-12)).alias("sd"))


def suggest_tags(scores: DataFrame, rows: DataFrame, active: DataFrame, k: int = SUGGEST) -> DataFrame:
    """The tags whose score on the given pages stands out most from the library's."""
    here = scores.join(rows.select("id").distinct(), "id", "left_semi").groupBy("tag").agg(F.avg("score").alias("here"))
    z = here.join(tag_spread(scores), "tag").select("tag", F.round((F.col("here") - F.col("mean")) / F.col("sd"), 9).alias("z"))
    return z.join(active.select("tag").distinct(), "tag", "left_semi").orderBy(F.desc("z"), "tag").limit(k)


def precheck(scores: DataFrame, rules: DataFrame, held: DataFrame, margin_sd: float = 0.0) -> DataFrame:
    """Tags a page does not hold, checked where the score clears its threshold with a margin."""
    spread = tag_spread(scores)
    s = scores.join(held.select("id", "tag").distinct(), ["id", "tag"], "left_anti")
    j = s.join(rules.select("tag", "threshold"), "tag").join(spread, "tag")
    t = F.col("threshold") + margin_sd * F.col("sd")
    return j.select("id", "tag", (F.col("score") >= t).alias("checked"), (1 / (1 + F.exp(-(F.col("score") - t) / F.col("sd")))).alias("p"))


def rank_strategies(scores: DataFrame, rules: DataFrame, strategy: str) -> DataFrame:
    """(id, tag, z, place) of each page's tags under one ranking rule.

    app: by z over the library · heads_only: tags with a head · heads_first: heads that
    clear their threshold, then the tags without one · margin: by score above threshold.
    """
    s = scores.join(rules.select("tag", "threshold", "head"), "tag").join(tag_spread(scores), "tag")
    value = (F.col("score") - F.col("threshold")) if strategy == "margin" else (F.col("score") - F.col("mean")) / F.col("sd")
    s = s.withColumn("z", F.round(value, 9)).withColumn("part", F.lit(0))
    if strategy == "heads_only":
        s = s.where(F.col("head"))
    elif strategy == "heads_first":
        s = s.where(~F.col("head") | (F.col("score") >= F.col("threshold"))).withColumn("part", F.when(F.col("head"), 0).otherwise(1))
    # One page's tags: bounded by the vocabulary.
    w = Window.partitionBy("id").orderBy("part", F.desc("z"), "tag")
    return s.select("id", "tag", "z", F.row_number().over(w).alias("place"))


STRATEGIES = {name: (lambda scores, rules, name=name: rank_strategies(scores, rules, name))
              for name in ("app", "heads_only", "heads_first", "margin")}


def blended_scores(vectors: DataFrame, query: Column, answers: DataFrame, head_c: float = 0.01) -> DataFrame:
    """(id, score, doubt) for one tag: its moved query and, with enough answers, a head.

    `answers` has (id, y). The query's weight falls as answers arrive: 10 / (10 + n).
    """
    from pagelib.operators.vectors import cosine_scores, refine

    n, pos = answers.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    moved = refine(vectors, query, answers.where("y = 1"), answers.where("y = 0"))
    both = min(pos, n - pos) >= 3
    stats = lambda df: (df.agg(F.avg("score")).scalar(), df.agg(F.greatest(F.stddev_pop("score"), F.lit(1e-12))).scalar())

    def zed(df: DataFrame, name: str) -> DataFrame:
        mean, sd = stats(df)
        return df.select("id", ((F.col("score") - mean) / sd).alias(name))

    scored = zed(cosine_scores(vectors, moved), "zq")
    alpha = 10 / (10 + n)
    if both:
        raw = _features(vectors)
        scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(raw)
        scaled = materialise(scaler.transform(raw).select("id", "features"), "scaled")
        weight = F.when(F.col("y") == 1, n / (2.0 * pos)).otherwise(n / (2.0 * (n - pos)))
        rows = scaled.join(answers, "id").select("features", F.col("y").cast("double").alias("label"), weight.alias("weight"))
        head = zed(_decisions(_fit(rows, n, head_c), scaled, "tag"), "zh")
        scored = scored.join(head, "id").select("id", (alpha * F.col("zq") + (1 - alpha) * F.col("zh")).alias("score"))
    else:
        scored = scored.select("id", F.col("zq").alias("score"))
    scored = materialise(scored, "blended")
    mean, sd = stats(scored)
    threshold = (best_threshold(scored.join(answers, "id").withColumn("tag", F.lit("tag")), ["tag"]).select("threshold").scalar()
                 if both else mean + 2.0 * sd)
    p = 1 / (1 + F.exp(-(F.col("score") - threshold) / sd))
    return scored.withColumn("doubt", 1 - F.abs(2 * p - 1))


def page_predictions(vectors: DataFrame, labels: DataFrame, folds: DataFrame, k: int, fit) -> DataFrame:
    """(id, tag, score, origin): out of fold for labelled pages, full fit for the rest, tags the page lacks only.

    `fit(train_vectors, train_labels, apply_to)` gives (id, tag, score).
    """
    lab = vectors.join(folds, "id")
    out = None
    for i in range(k):
        train = lab.where(F.col("fold") != i).select("id", "vector")
        s = fit(train, labels.join(train.select("id"), "id", "left_semi"), lab.where(F.col("fold") == i).select("id", "vector"))
        s = s.withColumn("origin", F.lit("out of fold"))
        out = s if out is None else out.unionByName(s)
    rest = vectors.join(folds.select("id"), "id", "left_anti")
    full = fit(lab.select("id", "vector"), labels, rest).withColumn("origin", F.lit("full fit"))
    return out.unionByName(full).join(labels.select("id", "tag").distinct(), ["id", "tag"], "left_anti")


# --- clusters

def cluster_pages(vectors: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(id, cluster) by k-means on unit rows."""
    rows = vectors.select("id", array_to_vector(V.unit("vector")).alias("features"))
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=20).fit(rows)
    return model.transform(rows).select("id", F.col("prediction").alias("cluster"))


def silhouette_curve(vectors: DataFrame, ks: list[int], seed: int = 0) -> DataFrame:
    """(k, silhouette) with cosine distance."""
    rows = materialise(vectors.select("id", array_to_vector(V.unit("vector")).alias("features")), "units")
    judge = ClusteringEvaluator(distanceMeasure="cosine")
    found = [(k, float(judge.evaluate(KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=20).fit(rows).transform(rows)))) for k in ks]
    return vectors.sparkSession.createDataFrame(found, "k int, silhouette double")


def overlaps(assign: DataFrame, tags: DataFrame) -> DataFrame:
    """(cluster, tag, both, size, holders) of every cluster and tag that share a page."""
    both = assign.join(tags.select("id", "tag").distinct(), "id").groupBy("cluster", "tag").agg(F.count(F.lit(1)).alias("both"))
    sizes = assign.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    held = tags.select("id", "tag").distinct().join(assign.select("id"), "id", "left_semi").groupBy("tag").agg(F.count(F.lit(1)).alias("holders"))
    return both.join(sizes, "cluster").join(held, "tag")


def jaccard(assign: DataFrame, tags: DataFrame) -> DataFrame:
    return overlaps(assign, tags).withColumn("jaccard", F.col("both") / (F.col("size") + F.col("holders") - F.col("both")))


def cluster_report(assign: DataFrame, tags: DataFrame) -> DataFrame:
    """Per cluster: size, best tag by Jaccard, purity, and whether any tag matches it."""
    best = jaccard(assign, tags).groupBy("cluster").agg(
        F.min(F.struct((-F.round("jaccard", 12)).alias("neg"), "tag")).alias("b"), F.max("both").alias("most"), F.max("size").alias("size"))
    return best.select("cluster", "size", F.col("b.tag").alias("best_tag"), (-F.col("b.neg")).alias("jaccard"),
                       (F.col("most") / F.col("size")).alias("purity"), (-F.col("b.neg") >= NO_MATCH_JACCARD).alias("matched"))


def tag_split_report(assign: DataFrame, tags: DataFrame) -> DataFrame:
    """Per tag: best cluster by F1, its largest share in one cluster, clusters with a tenth of it, and whether it is split."""
    o = overlaps(assign, tags).withColumns({"f1": F.round(2 * F.col("both") / (F.col("size") + F.col("holders")), 12),
                                            "share": F.col("both") / F.col("holders")})
    return o.groupBy("tag").agg(F.max("holders").alias("positives"), F.min(F.struct((-F.col("f1")).alias("neg"), "cluster")).alias("b"),
                                F.max("share").alias("largest_share"), F.count(F.when(F.col("share") >= 0.1, 1)).alias("clusters_with_10pct")).select(
        "tag", "positives", F.col("b.cluster").alias("best_cluster"), (-F.col("b.neg")).alias("best_cluster_f1"), "largest_share",
        "clusters_with_10pct", (F.col("largest_share") < 0.5).alias("split"))


def cluster_terms(assign: DataFrame, titles: DataFrame, stop_words: list[str] = (), top: int = 5) -> DataFrame:
    """The words that set each cluster apart, by cluster TF-IDF; `titles` has (id, title, host)."""
    words = F.regexp_extract_all(F.lower("title"), F.lit("[a-z][a-z0-9+#]{2,}"), F.lit(0))
    words = F.filter(words, lambda w: ~w.isin(list(stop_words))) if stop_words else words
    terms = titles.select("id", F.explode(F.concat(words, F.array_compact(F.array(F.nullif("host", F.lit("")))))).alias("term"))
    tf = assign.join(terms, "id").groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("n"))
    in_all = tf.groupBy("term").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("clusters")).where("clusters >= 2")
    tf = tf.join(in_all, "term")
    words_in = tf.groupBy("cluster").agg(F.sum("n").alias("words"))
    k = assign.select("cluster").distinct().agg(F.count(F.lit(1))).scalar()
    mean = words_in.agg(F.sum("words")).scalar() / k
    w = tf.join(words_in, "cluster").withColumn("weight", F.round(
        F.col("n") / F.col("words") * F.log(1 + mean / F.col("total")), 12))
    order = Window.partitionBy("cluster").orderBy(F.desc("weight"), "term")
    return w.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("cluster", "term", "weight", "place")


# --- deciding in a result set

def decide_in_set(scores: DataFrame, picked: DataFrame) -> DataFrame:
    """(id, tag, applied): each picked tag (tag, rate) applied to its top max(1, round(rate·N)) result pages."""
    s = scores.join(picked, "tag")
    n = scores.select("id").distinct().agg(F.count(F.lit(1))).scalar()
    placed = ordered.row_number(s, ["tag"], [F.desc("score"), F.asc("id")], [Coarse(ordered.score_bucket("score", 256), descending=True)], "place")
    k = F.greatest(F.lit(1), F.bround(F.col("rate") * n))
    return placed.select("id", "tag", (F.col("place") <= k).alias("applied"))


def pick_rates(result_sets: DataFrame, labels: DataFrame, tags: DataFrame, least: int = 3) -> DataFrame:
    """(tag, rate): median share of a result set's pages that hold the tag, over sets with at least three.

    `result_sets` has (set, id). A tag no set picks gets the median over every pick.
    """
    sizes = result_sets.groupBy("set").agg(F.count(F.lit(1)).alias("n"))
    held = result_sets.join(labels.select("id", "tag").distinct(), "id").groupBy("set", "tag").agg(F.count(F.lit(1)).alias("h"))
    shares = held.where(F.col("h") >= least).join(sizes, "set").withColumn("share", F.col("h") / F.col("n"))
    rates = shares.groupBy("tag").agg(F.median("share").alias("rate"))
    every = shares.agg(F.coalesce(F.median("share"), F.lit(0.0))).scalar()
    return tags.select("tag").distinct().join(rates, "tag", "left").select("tag", F.coalesce("rate", every).alias("rate"))
