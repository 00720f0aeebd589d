"""Exact top-k search by inner product with block-at-a-time pruning.

A coarse tree, fitted on a bounded hash sample, puts vectors that lie close together next to each other. In that order they
are dealt into ranges and, within a range, into blocks of 256. A block keeps its largest and smallest value of every term
(component) and its vectors as a forward index; the sum over terms of the best a block can give bounds its scores.

A query first searches the range it lies in and the range of its greatest bound. The k-th score found there goes to all
other ranges as its floor: only ranges with a bound that reaches it are searched, and only their vectors are copied to the
query's group. Inside a range blocks are visited in the order of their bounds and scored exactly until the next bound falls
below the k-th score. Results are exact; how much is skipped depends on how far the vectors cluster.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without an id. Shorter
vectors count as padded with zeros. Equal rows count once; rows that share a query's id are no candidates of it. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from pagelib.llm.common import query, table
from pagelib.session import materialise

RANGE = 4096         # vectors that meet a group of queries in one task
QUERIES = 1024       # queries of one group
BLOCK = 256          # vectors of one block
SAMPLE = 16_384      # bound of the hash sample that the order of the vectors is fitted on
LEAF = 16            # sample vectors of one leaf of that order
EXACT = float(1 << 53)
LEAST = np.iinfo(np.int64).min


def finite(vector: str):
    return (F.col(vector).isNotNull() & (F.size(vector) > 0)
            & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    """Rows padded with zeros."""
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; as doubles where those are exact."""
    reach = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    return (a @ b.T).astype(np.int64) if reach < EXACT else a.astype(np.int64) @ b.astype(np.int64).T


def fit_order(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and cuts of a full binary tree in heap order.

    A node cuts its vectors at their median along the direction in which they vary most (power iteration).
    """
    nodes = (1 << max(0, int(np.log2(max(1, len(sample) / LEAF))))) - 1
    normals, cuts, node = np.zeros((nodes, sample.shape[1])), np.zeros(nodes), np.zeros(len(sample), int)
    for at in range(nodes):
        held = node == at
        if not held.any():
            continue
        apart = sample[held] - sample[held].mean(0)
        w = apart[np.argmax((apart ** 2).sum(1))]
        for _ in range(12):
            w = w / (np.linalg.norm(w) or 1.0)
            w = apart.T @ (apart @ w)
        normals[at] = w / (np.linalg.norm(w) or 1.0)
        along = sample[held] @ normals[at]
        cuts[at] = np.median(along)
        node[held] = 2 * at + 1 + (along > cuts[at])
    return normals, cuts


def leaf_of(normals: np.ndarray, cuts: np.ndarray, dims: int):
    """A column function: vector -> number of its leaf, from left to right."""

    @pandas_udf("int")
    def leaf(vectors: pd.Series) -> pd.Series:
        x, node = matrix(vectors, dims), np.zeros(len(vectors), int)
        while len(node) and node[0] < len(cuts):
            node = 2 * node + 1 + (np.einsum("ij,ij->i", x, normals[node]) > cuts[node])
        return pd.Series(node - len(cuts))

    return leaf


def block_bounds(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest and smallest value of every term in each block."""
    starts = np.arange(0, len(values), BLOCK)
    return np.maximum.reduceat(values, starts), np.minimum.reduceat(values, starts)


def upper(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The most that a vector of each block can score, above any rounding of the sums."""
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    reach = np.abs(queries) @ np.maximum(np.abs(high), np.abs(low)).T
    return bounds + reach * 1e-12


def search_range(ids: np.ndarray, values: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int,
                 floor: np.ndarray | None = None):
    """(score, id) of each query's best k in one range, as two arrays of shape (queries, k), and pairs scored.

    LEAST stands where there is none. Scores below a query's `floor` may be missing. Blocks follow the given order.
    """
    high, low = block_bounds(values)
    bounds = upper(queries, high, low)
    visits = np.argsort(-bounds, axis=1, kind="stable")
    best = np.full((len(queries), k), LEAST)
    names = np.full((len(queries), k), np.iinfo(np.int64).max)
    floor = np.full(len(queries), LEAST) if floor is None else floor
    active, scored = np.arange(len(queries)), 0
    for turn in range(len(high)):
        block = visits[active, turn]
        going = bounds[active, block] >= np.maximum(best[active, k - 1], floor[active])
        active, block = active[going], block[going]
        if not len(active):
            break
        for b in np.unique(block):
            who = active[block == b]
            at = slice(b * BLOCK, (b + 1) * BLOCK)
            scores = products(queries[who], values[at])
            scored += scores.size
            own = query_ids[who, None] == ids[None, at]
            scores = np.concatenate([best[who], np.where(own, LEAST, scores)], axis=1)
            cand = np.concatenate([names[who], np.where(own, np.iinfo(np.int64).max, np.broadcast_to(ids[at], own.shape))], axis=1)
            top = np.lexsort((cand, -scores.astype(float) if np.abs(scores[scores > LEAST]).max(initial=0) < EXACT
                              else np.where(scores == LEAST, np.iinfo(np.int64).max, -scores)), axis=1)[:, :k]
            best[who], names[who] = np.take_along_axis(scores, top, 1), np.take_along_axis(cand, top, 1)
    return best, names, scored


def summarise(dims: int):
    """Bounds of a range's blocks."""

    def blocks(rows: pd.DataFrame) -> pd.DataFrame:
        high, low = block_bounds(matrix(rows.sort_values(["leaf", "vec_id"])["v"], dims))
        return pd.DataFrame({"range": rows["range"].iloc[0], "high": list(high), "low": list(low)})

    return blocks


def reach_cell(dims: int, first: bool):
    """Ranges that a query has to search: the one of the greatest bound (`first`), or all others that reach its floor."""

    def reach(blocks: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"row": [], "range": [], "bound": []}).astype({"row": "int64", "range": "int32", "bound": float})
        if not len(blocks) or not len(queries):
            return none
        blocks = blocks.sort_values("range", kind="stable")
        names, starts = np.unique(blocks["range"].to_numpy(), return_index=True)
        bounds = upper(matrix(queries["v"], dims), matrix(blocks["high"], dims), matrix(blocks["low"], dims))
        bounds = np.maximum.reduceat(bounds, starts, axis=1)
        if first:
            row, col = np.arange(len(queries)), bounds.argmax(1)
        else:
            seen = (names == queries["range"].to_numpy()[:, None]) | (names == queries["best"].to_numpy()[:, None])
            row, col = np.nonzero((bounds >= queries["floor"].to_numpy()[:, None]) & ~seen)
        return pd.DataFrame({"row": queries["row"].to_numpy()[row], "range": names[col], "bound": bounds[row, col]})

    return reach


def search_cell(k: int, dims: int, tally: Accumulator | None = None):
    def search(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        vectors = vectors.sort_values(["leaf", "vec_id"])
        asked = queries["query_id"].to_numpy()
        best, names, scored = search_range(vectors["vec_id"].to_numpy(), matrix(vectors["v"], dims), asked,
                                           matrix(queries["v"], dims), k, queries["floor"].to_numpy())
        if tally is not None:
            tally.add(scored)
        row, col = np.nonzero(best > LEAST)
        return pd.DataFrame({"query_id": asked[row], "vec_id": names[row, col], "score": best[row, col]})

    return search


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query, k: int = 10, tally: Accumulator | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of `vectors` (vec_id, v: array of whole numbers as doubles) for rows where `is_query`.

    `tally` counts the pairs that are scored.
    """
    vectors = materialise(vectors.select("vec_id", "v").distinct(), "topk-vectors")
    n, asked, dims = vectors.agg(F.count("*"), F.count(F.when(is_query, 1)), F.max(F.size("v"))).first()
    ranges, groups, dims = max(1, -(-n // RANGE)), max(1, -(-asked // QUERIES)), dims or 1
    lot = F.pmod(F.xxhash64("vec_id", F.lit(29)), F.lit(1 << 40))
    sample = vectors.where(lot < F.lit(int((1 << 40) * min(1.0, SAMPLE / max(n, 1))))).select("v").toPandas()
    leaf = leaf_of(*fit_order(matrix(sample["v"], dims)), dims)
    # The borders of ranges and groups are sampled, so tables are written with them: a recomputed task finds the same ones.
    ranged = vectors.withColumn("leaf", leaf("v")).repartitionByRange(ranges, "leaf", "vec_id")
    ranged = materialise(ranged.withColumn("range", F.spark_partition_id()), "topk-ranges")
    queries = ranged.where(is_query).repartitionByRange(groups, "leaf", "vec_id")
    queries = materialise(queries.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").alias("query_id"), "v", "range",
                                         F.spark_partition_id().alias("group")), "topk-queries")
    parts = -(-ranges // BLOCK)       # as many block bounds in a part as vectors in a range
    blocks = materialise(ranged.groupBy("range").applyInPandas(summarise(dims), "range int, high array<double>, low array<double>")
                         .withColumn("part", F.pmod("range", F.lit(parts))), "topk-blocks")

    def reach(queries: DataFrame, first: bool) -> DataFrame:
        left = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        right = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return (left.groupBy("part", "group").cogroup(right.groupBy("part", "group"))
                .applyInPandas(reach_cell(dims, first), "row long, range int, bound double"))

    def search(pairs: DataFrame) -> DataFrame:
        cells = pairs.select(F.col("range").alias("range"), F.col("group").alias("group")).distinct()
        return (ranged.join(cells, "range").groupBy("range", "group").cogroup(pairs.groupBy("range", "group"))
                .applyInPandas(search_cell(k, dims, tally), "query_id long, vec_id long, score long"))

    best = reach(queries, True).groupBy("row").agg(F.max_by("range", F.struct("bound", "range")).alias("best"))
    asked = materialise(queries.join(best, "row"), "topk-asked")
    seeds = F.array_distinct(F.array("range", "best"))
    found = materialise(ranked(search(asked.withColumn("range", F.explode(seeds)).withColumn("floor", F.lit(LEAST).cast("long"))), k),
                        "topk-first")
    floors = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    asked = asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(LEAST).cast("long")))
    left_over = materialise(reach(asked, False).select("row", "range"), "topk-reached")
    more = search(left_over.join(asked.drop("range", "best"), "row"))
    return ranked(found.drop("rank").union(more), k)


SQL_OP9 = """
WITH v AS MATERIALIZED (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""


@query("op9_topk", SQL_OP9)
def op9_topk(spark, folder):
    given = table(spark, folder, "embeddings").where(F.col("vec_id").isNotNull() & finite("embedding"))
    whole = given.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024).cast("double")).alias("v"))
    return top_k(whole, F.col("vec_id") % 100 == 0)
