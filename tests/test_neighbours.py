"""Neighbours from candidates against the exact form."""

import numpy as np
import pytest

from pagelib.operators import neighbours
from pagelib.operators.vectors import top_k_neighbours


def unit_rows(spark, x, first=0):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")


@pytest.fixture(scope="module")
def clustered(spark):
    """5,000 rows in 50 clusters, and a third more in one of them."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(50, 16))
    x = np.concatenate([centres[rng.integers(50, size=5000)], np.repeat(centres[:1], 2500, 0)]) + rng.normal(size=(7500, 16)) * 0.25
    return unit_rows(spark, x), unit_rows(spark, centres[rng.integers(50, size=300)] + rng.normal(size=(300, 16)) * 0.25, 100_000)


def test_recall_on_clusters_with_a_hot_one(clustered):
    train, test = clustered
    exact = {(r.left, r.right) for r in top_k_neighbours(test, train, 10).collect()}
    got = neighbours.near_neighbours(test, train, 10).collect()
    near = {(r.left, r.right) for r in got}
    assert len(near) == len(got) == 3000 and len(near & exact) / len(exact) >= 0.95
    assert {r.place for r in got} == set(range(1, 11))


def test_every_cell_gives_the_exact_answer_in_any_blocks(monkeypatch, clustered):
    monkeypatch.setattr(neighbours, "BLOCK", 200)
    train, test = clustered
    want = sorted(tuple(r) for r in top_k_neighbours(test, train, 5).collect())
    got = neighbours.near_neighbours(test, train, 5, probes=1000, cells=20)
    assert sorted(tuple(r) for r in got.select("left", "right", "score", "place").collect()) == want


def test_no_task_holds_a_hot_cell(monkeypatch, clustered):
    monkeypatch.setattr(neighbours, "BLOCK", 200)
    train, _ = clustered
    centroids = neighbours.fit_centroids(train, 20)
    sizes = [r["count"] for r in neighbours.store_cells(train, centroids).groupBy("cell", "block").count().collect()]
    assert sum(sizes) == 7500 and max(sizes) < 320


def test_small_and_empty_tables(spark, clustered):
    train, test = clustered
    assert neighbours.near_neighbours(test, train.limit(0), 3).collect() == []
    assert neighbours.near_neighbours(test.limit(0), train, 3).collect() == []
    few = neighbours.near_neighbours(test.limit(4), train.limit(2), 3).collect()
    assert sorted(r.place for r in few) == [1] * 4 + [2] * 4
