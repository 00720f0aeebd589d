"""Page and tag vectors: products in blocks, pooling, prototypes, reuse of stored vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pagelib.functions import vectors as V
from pagelib.session import materialise

BLOCK = 4096
ROUND = 9
NEGATIVE_WEIGHT = 0.25
# Marks that stand for media in a model's input.
MEDIA_MARKERS = ["<|image|>", "<|audio|>", "<|video|>"]


def _block_pairs(left: DataFrame, right: DataFrame, block: int):
    """Both sides dealt into blocks of about `block` rows by a hash of their id, every pair of blocks once."""
    def blocks(df: DataFrame) -> Column:
        return F.greatest(F.ceil(df.agg(F.count(F.lit(1))).scalar() / block), F.lit(1)).cast("int")

    n_left, n_right = blocks(left), blocks(right)
    of = lambda df, n: F.pmod(F.xxhash64("id"), n).cast("int")
    more = [F.col("floor").cast("double").alias("floor")] if "floor" in right.columns else []
    a = left.select(F.col("id").alias("id"), V.doubles("vector").alias("vector"), of(left, n_left).alias("i"),
                    F.explode(F.sequence(F.lit(0), n_right - 1)).alias("j"))
    b = right.select(F.col("id").alias("id"), V.doubles("vector").alias("vector"), *more, of(right, n_right).alias("j"),
                     F.explode(F.sequence(F.lit(0), n_left - 1)).alias("i"))
    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j"))


def _scores(x: pd.DataFrame, y: pd.DataFrame) -> np.ndarray:
    return np.round(np.stack(x["vector"].to_list()) @ np.stack(y["vector"].to_list()).T, ROUND)


def blocked_products(left: DataFrame, right: DataFrame, k: int | None = None, block: int = BLOCK) -> DataFrame:
    """Dot products of every left vector with every right one, `k` best per left row if given.

    Both sides are (id, vector). Rows fall into blocks of about `block` by a hash of
    their id; each pair of blocks is one matrix product, and with `k` only the best of
    a block leave it. Task memory is bounded by two blocks, whatever the table sizes.
    If the right side has a `floor` too, scores of at least that stay beside the `k` best, and `clears` marks them.
    """
    floors = "floor" in right.columns and k is not None

    def product(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            none = pd.DataFrame({"left": x["id"].head(0), "right": y["id"].head(0), "score": []})
            return none.assign(clears=np.zeros(0, bool)) if floors else none
        y = y.sort_values("id")
        s = _scores(x, y)
        m = s.shape[1] if k is None else min(k, s.shape[1])
        top = np.argsort(-s, axis=1, kind="stable")[:, :m]
        if floors:
            clears = s >= y["floor"].to_numpy()
            stays = clears.copy()
            np.put_along_axis(stays, top, True, axis=1)
            row, col = np.nonzero(stays)
            return pd.DataFrame({"left": x["id"].to_numpy()[row], "right": y["id"].to_numpy()[col], "score": s[row, col],
                                 "clears": clears[row, col]})
        return pd.DataFrame({"left": np.repeat(x["id"].to_numpy(), m), "right": y["id"].to_numpy()[top.ravel()],
                             "score": np.take_along_axis(s, top, axis=1).ravel()})

    lt, rt = left.schema["id"].dataType.simpleString(), right.schema["id"].dataType.simpleString()
    pairs = _block_pairs(left, right, block).applyInPandas(
        product, f"left {lt}, right {rt}, score double" + (", clears boolean" if floors else ""))
    if k is None:
        return pairs
    w = Window.partitionBy("left").orderBy(F.desc("score"), "right")
    placed = pairs.withColumn("place", F.row_number().over(w))
    return placed.where((F.col("place") <= k) | F.col("clears")) if floors else placed.where(F.col("place") <= k)


def product_moments(left: DataFrame, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, n, mean, sd) of each right vector's products with all left ones; a pair of blocks gives one row per right vector.

    Deviations are summed around each block's own mean, so large means take no digits from them.
    """
    def sums(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"id": y["id"].head(0), "n": np.zeros(0, "int64"), "mean": [], "spread": []})
        s = _scores(x, y)
        return pd.DataFrame({"id": y["id"].to_numpy(), "n": len(s), "mean": s.mean(0), "spread": ((s - s.mean(0)) ** 2).sum(0)})

    kind = right.schema["id"].dataType.simpleString()
    parts = _block_pairs(left, right.select("id", "vector"), block).applyInPandas(sums, f"id {kind}, n long, mean double, spread double")
    parts = materialise(parts, "moments")
    whole = parts.groupBy("id").agg(F.sum("n").alias("n_all"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean_all"))
    off = F.col("mean") - F.col("mean_all")
    sd = F.sqrt(F.sum(F.col("spread") + F.col("n") * off * off) / F.first("n_all"))
    return (parts.join(whole, "id").groupBy("id")
            .agg(F.first("n_all").alias("n"), F.first("mean_all").alias("mean"), sd.alias("sd")))


def top_k_neighbours(test: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """(left, right, score, place): the k nearest training rows of each test row by cosine."""
    return blocked_products(test, train, k)


def cosine_scores(vectors: DataFrame, query: Column) -> DataFrame:
    """(id, score) of unit vectors against one unit query vector."""
    return vectors.select("id", "vector", query.alias("q")).select(
        "id", F.round(V.dot("vector", "q"), ROUND).alias("score"))


def fuse_vectors(df: DataFrame, a: str, b: str) -> DataFrame:
    """`fused` = unit(a + b), and `joined` = a, b or zeros, and whether b is missing."""
    zeros = F.transform(V.doubles(a), lambda x: F.lit(0.0))
    flag = F.when(F.col(b).isNull(), 1.0).otherwise(0.0)
    return df.withColumns({"fused": V.unit(V.add(a, b)),
                           "joined": F.concat(V.doubles(a), F.coalesce(V.doubles(b), zeros), F.array(flag))})


def mean_pool(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Unit mean of each page's chunk vectors; pages without chunks keep their own."""
    pooled = chunks.groupBy("page_id").agg(V.mean("vector").alias("pooled")).withColumnRenamed("page_id", "id")
    return pages.join(pooled, "id", "left").select(
        "id", F.coalesce(V.unit("pooled"), V.doubles("vector")).alias("vector"), F.col("pooled").isNotNull().alias("from_chunks"))


def class_means(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """(tag, vector): unit mean of the vectors carrying each tag."""
    return (labels.select("id", "tag").distinct().join(vectors, "id").groupBy("tag")
            .agg(V.mean("vector").alias("m")).select("tag", V.unit("m").alias("vector")))


def prototype_queries(vectors: DataFrame, labels: DataFrame, queries: DataFrame) -> DataFrame:
    """Tag queries replaced by the unit mean of the tag's positives; unseen tags keep theirs."""
    seen = class_means(vectors, labels).withColumnRenamed("vector", "seen")
    return queries.join(seen, "tag", "left").select("tag", F.coalesce("seen", V.doubles("vector")).alias("vector"))


def refine(vectors: DataFrame, query: Column, included: DataFrame, excluded: DataFrame) -> Column:
    """unit(q + mean(included) − 0.25 mean(excluded)) as a scalar; an empty set drops its term."""
    def mean_of(ids: DataFrame) -> Column:
        return vectors.join(ids.select("id").distinct(), "id", "left_semi").agg(V.mean("vector")).scalar()

    terms = vectors.sparkSession.range(1).select(query.alias("q"), mean_of(included).alias("p"), mean_of(excluded).alias("n"))
    return terms.select(V.unit(V.add(V.add("q", "p"), "n", -NEGATIVE_WEIGHT)).alias("v")).scalar()


def zero_shot(vectors: DataFrame, queries: DataFrame, images: DataFrame | None = None, sd: float = 2.0,
              k: int | None = None) -> DataFrame:
    """(id, tag, score, predicted): cosine to each tag's query, averaged with the image's where there is one.

    Without labels a tag is predicted above its mean plus `sd` standard deviations. With `k`, only each page's `k` best tags
    and its predicted ones come back: the first product leaves moments of each tag, the second the cells that stay, so what
    leaves a task grows with `k` and the predictions, not with pages times tags.
    """
    q = queries.select(F.col("tag").alias("id"), "vector")
    if k is not None:
        v = vectors.select("id", V.doubles("vector").alias("vector"))
        if images is not None:      # the mean of two products is one product of the vectors side by side
            half = lambda c: F.transform(c, lambda x: x / 2)
            j = v.join(images.select("id", V.doubles("vector").alias("image")), "id", "left")
            v = j.select("id", F.when(F.col("image").isNull(), F.concat("vector", F.transform("vector", lambda x: F.lit(0.0))))
                         .otherwise(F.concat(half("vector"), half("image"))).alias("vector"))
            q = q.select("id", F.concat(V.doubles("vector"), V.doubles("vector")).alias("vector"))
        rules = materialise(product_moments(v, q).select("id", (F.col("mean") + sd * F.col("sd")).alias("floor")), "rules")
        kept = blocked_products(v, q.join(rules, "id"), k).join(rules.withColumnRenamed("id", "right"), "right")
        kept = kept.withColumn("predicted", F.col("score") > F.col("floor")).where((F.col("place") <= k) | F.col("predicted"))
        return kept.select(F.col("left").alias("id"), F.col("right").alias("tag"), "score", "predicted")
    s = blocked_products(vectors.select("id", "vector"), q)
    if images is not None:
        i = blocked_products(images.select("id", "vector"), q).withColumnRenamed("score", "image")
        s = s.join(i, ["left", "right"], "left").withColumn(
            "score", F.when(F.col("image").isNotNull(), (F.col("score") + F.col("image")) / 2).otherwise(F.col("score")))
    s = s.select(F.col("left").alias("id"), F.col("right").alias("tag"), "score")
    stats = s.groupBy("tag").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("sd"))
    return s.join(stats, "tag").select("id", "tag", "score", (F.col("score") > F.col("m") + sd * F.col("sd")).alias("predicted"))


def reconcile_vectors(wanted: DataFrame, stored: DataFrame, model: Column, retain: bool = False) -> DataFrame:
    """Every id with what happens to it: reused, stale, missing, masked, retained or dropped.

    `wanted` has (id, hash, masked ∈ true where an optional input is absent), `stored`
    (id, hash, model, vector). Reused and retained rows keep their vector; stale and
    missing ones go to `embed`.
    """
    s = stored.select("id", F.col("hash").alias("old_hash"), F.col("model").alias("old_model"), "vector")
    w = wanted.select("id", "hash", F.coalesce("masked", F.lit(False)).alias("masked"), F.lit(True).alias("wanted"))
    j = w.join(s, "id", "full_outer")
    same_model = F.col("old_model") == model
    fresh = same_model & (F.col("hash") == F.col("old_hash"))
    status = (F.when(F.col("wanted").isNull(), F.when(F.lit(retain) & same_model, "retained").otherwise("dropped"))
              .when(F.col("masked"), "masked").when(fresh, "reused").when(F.col("old_hash").isNotNull(), "stale")
              .otherwise("missing"))
    return j.select("id", "hash", status.alias("status"), F.when(status.isin("reused", "retained"), F.col("vector")).alias("vector"))


def embed(reconciled: DataFrame, texts: DataFrame, fn) -> DataFrame:
    """The new generation (id, hash, vector); `fn` is a caller-given pandas UDF text → array<float>.

    A text it returns NULL for failed and is left out, to be tried again.
    """
    kept = reconciled.where(F.col("status").isin("reused", "retained")).select("id", "hash", "vector")
    need = reconciled.where(F.col("status").isin("stale", "missing")).select("id", "hash").join(texts, "id")
    new = need.select("id", "hash", fn("text").alias("vector")).where(F.col("vector").isNotNull())
    return kept.unionByName(new)


def embed_text(title: Column, text: Column) -> Column:
    """The model's input: the whole text under its title, media marks kept as plain text.

    A caller whose model reads only so much embeds chunks and pools them (`mean_pool`).
    """
    out = F.concat(F.lit("title: "), F.when(F.coalesce(title, F.lit("")) == "", "none").otherwise(title),
                   F.lit(" | text: "), text)
    for mark in MEDIA_MARKERS:
        out = F.replace(out, F.lit(mark), F.lit("< " + mark[1:]))
    return out


def embed_documents(docs: DataFrame, fn) -> DataFrame:
    return docs.select("id", fn(embed_text(F.col("title"), F.col("text"))).alias("vector"))
