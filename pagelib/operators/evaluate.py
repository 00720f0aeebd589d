"""Evaluation of tag models: precision and recall curves, folds, comparisons."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pagelib.functions import ordered
from pagelib.functions.ordered import Coarse

TIMING_SUFFIXES = ["seconds", "_s", "_ms", "_mb", "_median", "_p90"]


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / F.when(b != 0, b))


def cumulative_precision_recall(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and distinct score: rows and positives scored at least that.

    `scores` has the keys, score and y (0/1). Ties count together because rows are
    summed per score first; the running sums then run over score buckets.
    """
    counts = scores.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("pos"))
    coarse = [Coarse(ordered.score_bucket("score", 256), descending=True)]
    order = [F.desc("score")]
    shown = ordered.running(counts, keys, order, coarse, "predicted", F.col("n"))
    return ordered.running(shown, keys, order, coarse, "tp", F.col("pos"))


def with_totals(scores: DataFrame, keys: list[str]) -> DataFrame:
    """`cumulative_precision_recall` with each key's positives."""
    curve = cumulative_precision_recall(scores, keys)
    if not keys:
        return curve.withColumn("positives", scores.agg(F.sum("y")).scalar().cast("long"))
    totals = scores.groupBy(*keys).agg(F.sum("y").cast("long").alias("positives"))
    return curve.join(totals, keys)


def average_precision(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of precision at each step of recall; NULL without positives."""
    if not keys:
        scores, keys = scores.withColumn("__all", F.lit(1)), ["__all"]
    step = F.sum(F.col("pos") * F.col("tp") / F.col("predicted")) / F.max("positives")
    out = with_totals(scores, keys).groupBy(*keys).agg(F.when(F.max("positives") > 0, step).alias("ap"))
    return out.drop("__all") if keys == ["__all"] else out


def best_threshold(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The score to predict from with the best F1, the lowest on ties; infinite without positives."""
    f1 = 2 * F.col("tp") / (F.col("predicted") + F.col("positives"))
    best = with_totals(scores, keys).withColumn("f1", f1).groupBy(*keys).agg(
        F.max(F.struct("f1", (-F.col("score")).alias("neg"))).alias("b"), F.max("positives").alias("positives"))
    return best.select(*keys, F.when(F.col("positives") == 0, float("inf")).otherwise(-F.col("b.neg")).alias("threshold"),
                       F.when(F.col("positives") > 0, F.col("b.f1")).otherwise(0.0).alias("f1"))


def tag_metrics(rows: DataFrame) -> DataFrame:
    """Precision, recall, F1, AP, support and predicted per tag; `rows` has (tag, score, y, pred)."""
    y, p = F.col("y") == 1, F.col("pred")
    sums = rows.groupBy("tag").agg(F.count(F.when(y & p, 1)).alias("tp"), F.count(F.when(y, 1)).alias("support"),
                                   F.count(F.when(p, 1)).alias("predicted"))
    return _rates(sums).join(average_precision(rows, ["tag"]), "tag")


def _rates(sums: DataFrame) -> DataFrame:
    tp = F.col("tp")
    return sums.withColumns({"precision": ratio(tp, F.col("predicted")), "recall": ratio(tp, F.col("support")),
                             "f1": ratio(2 * tp, F.col("predicted") + F.col("support"))})


def summary_metrics(rows: DataFrame, per_tag: DataFrame) -> DataFrame:
    """Micro figures over all cells and macro means over tags; AP leaves out tags without positives."""
    macro = per_tag.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1", "ap")]).withColumn("level", F.lit("macro"))
    y, p = F.col("y") == 1, F.col("pred")
    micro = _rates(rows.agg(F.count(F.when(y & p, 1)).alias("tp"), F.count(F.when(y, 1)).alias("support"),
                            F.count(F.when(p, 1)).alias("predicted")))
    micro = micro.withColumn("ap", average_precision(rows, []).scalar()).withColumn("level", F.lit("micro"))
    columns = ["level", "precision", "recall", "f1", "ap"]
    return macro.select(*columns).unionByName(micro.select(*columns))


def stratified_folds(labels: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """(id, fold): pages of each stratum, the page's rarest tag, dealt over folds in hash order.

    Repeatable and balanced per tag; not the assignment another library's generator
    would draw.
    """
    sizes = labels.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    rarest = labels.join(sizes, "tag").groupBy("id").agg(F.min(F.struct("n", "tag")).alias("r")).select(
        "id", F.col("r.tag").alias("stratum"))
    hashed = rarest.withColumn("h", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")), 256))
    dealt = ordered.row_number(hashed, ["stratum"], [F.col("h"), F.col("id")], [Coarse(F.substring("h", 1, 2))], "n")
    return dealt.select("id", ((F.col("n") - 1) % k).alias("fold"))


def cross_validate(data: DataFrame, folds: DataFrame, k: int,
                   fit_and_score: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Pooled test scores: each fold is scored once by what was fitted on the others."""
    tagged = data.join(folds, "id")
    out = None
    for i in range(k):
        scored = fit_and_score(tagged.where(F.col("fold") != i).drop("fold"), tagged.where(F.col("fold") == i).drop("fold"))
        out = scored if out is None else out.unionByName(scored)
    return out


def _group_of(rows: DataFrame, group: str | None) -> DataFrame:
    return rows.withColumn("group", F.lit("overall") if group is None else F.col(group))


def precision_recall_hit_at_3(truth: DataFrame, ranked: DataFrame, group: str | None = None, k: int = 3) -> DataFrame:
    """Page macro, micro and tag macro precision, recall and hit rate at k, per group of tags.

    `truth` has (id, tag[, group]), `ranked` (id, tag, place[, group]). Precision is over
    pages with predictions, recall and hits over pages with truth.
    """
    t = _group_of(truth, group).select("group", "id", "tag", F.lit(1).alias("y"))
    p = _group_of(ranked.where(F.col("place") <= k), group).select("group", "id", "tag", F.lit(1).alias("p"))
    cells = t.join(p, ["group", "id", "tag"], "full_outer")
    tp = F.sum(F.when(F.col("y").isNotNull() & F.col("p").isNotNull(), 1).otherwise(0))
    sums = lambda *by: cells.groupBy(*by).agg(tp.alias("tp"), F.count("y").alias("pos"), F.count("p").alias("pred"))
    pages = sums("group", "id").groupBy("group").agg(
        F.avg(F.when(F.col("pred") > 0, F.col("tp") / F.col("pred"))).alias("page_precision"),
        F.avg(F.when(F.col("pos") > 0, F.col("tp") / F.col("pos"))).alias("page_recall"),
        F.avg(F.when(F.col("pos") > 0, (F.col("tp") > 0).cast("double"))).alias("hit"),
        F.sum("tp").alias("tp"), F.sum("pos").alias("positives"), F.sum("pred").alias("predictions"))
    tags = sums("group", "tag").groupBy("group").agg(F.avg(ratio(F.col("tp"), F.col("pred"))).alias("tag_precision"),
                                                     F.avg(ratio(F.col("tp"), F.col("pos"))).alias("tag_recall"))
    return pages.join(tags, "group").withColumns({
        "micro_precision": ratio(F.col("tp"), F.col("predictions")), "micro_recall": ratio(F.col("tp"), F.col("positives"))})


def choose_cut(scores: DataFrame, pages: int | Column, target: float) -> DataFrame:
    """The score cut whose shown-per-page is closest to the target; ties take the higher cut."""
    counts = scores.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    shown = ordered.running(counts, [], [F.desc("score")], [Coarse(ordered.score_bucket("score", 256), descending=True)],
                            "shown", F.col("n"))
    none = scores.sparkSession.range(1).select(F.lit(float("inf")).alias("score"), F.lit(0).cast("long").alias("shown"))
    cuts = shown.select("score", "shown").unionByName(none).withColumn("per_page", F.col("shown") / pages)
    best = cuts.agg(F.min(F.struct(F.abs(F.col("per_page") - target).alias("gap"), (-F.col("score")).alias("neg"), "per_page")).alias("b"))
    return best.select((-F.col("b.neg")).alias("cut"), F.col("b.per_page").alias("shown_per_page"))


def abstention_curve(truth: DataFrame, ranked: DataFrame, cuts: dict[float, float], pages: Column) -> DataFrame:
    """Per operating point: shown per page, share of pages shown nothing, precision and recall.

    Each ranked suggestion is expanded once per cut it clears.
    """
    points = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(c).alias("cut")) for t, c in cuts.items()])
    shown = ranked.withColumn("point", F.explode(points)).where(F.col("score") >= F.col("point.cut")).select(
        "id", "tag", "place", F.col("point.target").cast("string").alias("target"))
    asked = truth.withColumn("target", F.explode(F.array(*[F.lit(str(t)) for t in cuts])))
    volume = shown.groupBy("target").agg((F.count(F.lit(1)) / pages).alias("shown_per_page"),
                                         (1 - F.countDistinct("id") / pages).alias("none_shown_share"))
    quality = precision_recall_hit_at_3(asked, shown, "target")
    return quality.withColumnRenamed("group", "target").join(volume, "target")


def paired_runs(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """Ids whose fold or truth differ between two runs, or that one of them lacks; empty means comparable."""
    b = baseline.select("id", F.col("fold").alias("fold_b"), F.col("truth").alias("truth_b"), F.lit(1).alias("b"))
    j = candidate.withColumn("a", F.lit(1)).join(b, "id", "full_outer")
    return j.select("id", F.when(F.col("a").isNull(), "missing in candidate").when(F.col("b").isNull(), "missing in baseline")
                    .when(F.col("fold") != F.col("fold_b"), "fold differs").when(F.col("truth") != F.col("truth_b"), "truth differs")
                    .alias("problem")).where(F.col("problem").isNotNull())


def paired_bootstrap(rates: DataFrame, samples: int = 10000, seed: int = 0) -> DataFrame:
    """Mean paired difference with its 2.5 and 97.5 percentiles, whole pages resampled.

    `rates` has (id, a, b). Each page counts with a Poisson weight of its own; n pages of
    one difference together weigh Poisson(n), so a draw is made per distinct difference
    and sample, seeded by the difference.
    """
    def sums(batches):
        total, weights = np.zeros(samples), np.zeros(samples)
        for batch in batches:
            for d, n in zip(batch["d"], batch["n"]):
                w = np.random.default_rng([seed, int(np.float64(d + 0.0).view(np.uint64))]).poisson(float(n), samples)
                total += w * d
                weights += w
        yield pd.DataFrame({"sample": np.arange(samples), "total": total, "weight": weights})

    counted = rates.groupBy((F.col("a") - F.col("b")).alias("d")).agg(F.count("*").alias("n")).where("d is not null")
    per = counted.mapInPandas(sums, "sample int, total double, weight double").groupBy("sample").agg(
        (F.sum("total") / F.sum("weight")).alias("mean"))
    point = rates.agg(F.avg(F.col("a") - F.col("b"))).scalar()
    return per.agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select(
        point.alias("difference"), F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))


def compare_runs(a: DataFrame, b: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Metrics (path, value) of two runs: compared, differing and the largest gap; timings are left out."""
    timing = F.col("path").contains("/latency/")
    for suffix in TIMING_SUFFIXES:
        timing = timing | F.col("path").endswith(suffix)
    j = a.select("path", F.col("value").alias("x"), F.lit(1).alias("in_a")).join(
        b.select("path", F.col("value").alias("y"), F.lit(1).alias("in_b")), "path", "full_outer").where(~timing)
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    gap = F.when(both & F.col("x").isNotNull() & F.col("y").isNotNull(), F.abs(F.col("x") - F.col("y")))
    j = j.withColumn("gap", gap)
    differs = F.when(F.col("gap").isNotNull(), F.col("gap") > tolerance).otherwise(~both | ~F.col("x").eqNullSafe(F.col("y")))
    return j.agg(F.count(F.lit(1)).alias("compared"), F.count(F.when(differs, 1)).alias("differing"),
                 F.coalesce(F.max("gap"), F.lit(0.0)).alias("largest_gap"), F.max_by("path", "gap").alias("largest_gap_at"))
