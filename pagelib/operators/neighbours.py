"""Nearest neighbours from candidates: an inverted file over coarse centroids.

`vectors.top_k_neighbours` compares every test row with every training row, which suits a bounded set of test rows. Here a
training row stands in the cell of its nearest centroid, a test row asks the `probes` cells nearest to it, and the candidates
in these cells are compared exactly; the best k of all cells are the answer. The number of cells grows with the root of the
training rows, so work grows with rows to the power 1.5. With as many probes as cells the answer is that of the exact form.

Centroids are fitted on a hash sample of SAMPLE rows a cell at most, so they do not grow the work either. A cell that holds
more than BLOCK rows is cut into blocks by a hash of the id, and a test row asks each: no task holds a whole cell.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F

from pagelib.functions import vectors as V
from pagelib.operators.vectors import ROUND
from pagelib.session import materialise

BLOCK = 4096
SAMPLE = 64
PROBES = 8
MOST_CELLS = 16_384     # of so many centroids a task holds a copy
SEED = 0


def cells_for(rows: int) -> int:
    return max(1, min(MOST_CELLS, round(math.sqrt(rows))))


def fit_centroids(train: DataFrame, cells: int | None = None) -> np.ndarray:
    """Unit centroids of training rows (id, vector), as many as the root of their number unless given."""
    n = train.count()
    cells = min(cells or cells_for(n), n)
    if not n:
        return np.empty((0, 0))
    if cells < 2:     # one cell holds everything, wherever its centre is
        return np.zeros((1, len(train.select("vector").first()[0])))
    lot = F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1 << 20))
    chosen = train.where(lot < F.lit(max(1, int((1 << 20) * min(1.0, SAMPLE * cells / n)))))
    rows = materialise(chosen.select(array_to_vector(V.unit("vector")).alias("features")), "centroid-sample")
    if rows.count() < cells:
        rows = materialise(train.select(array_to_vector(V.unit("vector")).alias("features")), "centroid-sample")
    model = KMeans(k=cells, seed=SEED, distanceMeasure="cosine", maxIter=10, initSteps=2).fit(rows)
    found = np.array(model.clusterCenters())
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)


def _in_cells(df: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """`df` (id, vector) once for each of its nearest cells."""
    shared = df.sparkSession.sparkContext.broadcast(centroids.T)     # at most MOST_CELLS centroids

    @F.pandas_udf("array<int>")
    def nearest(batch: pd.Series) -> pd.Series:
        scores = np.stack(batch.to_list()) @ shared.value if len(batch) else np.empty((0, 1))
        if probes >= scores.shape[1]:
            return pd.Series([list(range(scores.shape[1]))] * len(batch))
        return pd.Series(list(np.argpartition(-scores, probes - 1, axis=1)[:, :probes].astype(np.int32)))

    return df.select("id", V.doubles("vector").alias("vector")).withColumn("cell", F.explode(nearest("vector")))


def store_cells(train: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Training rows (cell, block, id, vector) with their cell, written to the shared folder; asked any number of times."""
    placed = materialise(_in_cells(train, centroids, 1), "cells-placed")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))     # a row a cell
    block = F.pmod(F.xxhash64("id", F.lit(31)), F.col("blocks")).cast("int")
    return materialise(placed.join(F.broadcast(sizes), "cell").select("cell", block.alias("block"), "blocks", "id", "vector"), "cells")


def ask_cells(test: DataFrame, stored: DataFrame, centroids: np.ndarray, k: int, probes: int = PROBES) -> DataFrame:
    """(left, right, score, place): the k best candidates of each test row by product, ties by id."""
    kinds = [df.schema["id"].dataType.simpleString() for df in (test, stored)]
    empty = test.sparkSession.createDataFrame([], f"left {kinds[0]}, right {kinds[1]}, score double, place int")
    if not len(centroids):
        return empty
    asked = materialise(_in_cells(test, centroids, probes), "cells-asked")
    # One row a cell: its blocks, and the lots that the rows asking it are dealt into; each lot meets each block.
    blocks = stored.groupBy("cell").agg(F.max("blocks").alias("blocks"))
    lots = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("lots"))
    split = F.broadcast(blocks.join(lots, "cell"))
    asked = (asked.join(split, "cell").withColumn("lot", F.pmod(F.xxhash64("id", F.lit(37)), F.col("lots")).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", "block", "lot", "id", "vector"))
    held = (stored.select("cell", "block", "id", "vector").join(split, "cell")
            .withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).select("cell", "block", "lot", "id", "vector"))

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"left": x["id"].head(0), "right": y["id"].head(0), "score": []})
        y = y.sort_values("id")
        s = np.round(np.stack(x["vector"].to_list()) @ np.stack(y["vector"].to_list()).T, ROUND)
        m = min(k, s.shape[1])
        top = np.argsort(-s, axis=1, kind="stable")[:, :m]
        return pd.DataFrame({"left": np.repeat(x["id"].to_numpy(), m), "right": y["id"].to_numpy()[top.ravel()],
                             "score": np.take_along_axis(s, top, axis=1).ravel()})

    keys = ["cell", "block", "lot"]
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(best, f"left {kinds[0]}, right {kinds[1]}, score double")
    order = Window.partitionBy("left").orderBy(F.desc("score"), "right")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def near_neighbours(test: DataFrame, train: DataFrame, k: int, probes: int = PROBES, cells: int | None = None) -> DataFrame:
    """(left, right, score, place) of unit vectors (id, vector): `top_k_neighbours` from candidates."""
    centroids = fit_centroids(train, cells)
    return ask_cells(test, store_cells(train, centroids) if len(centroids) else train, centroids, k, probes)
