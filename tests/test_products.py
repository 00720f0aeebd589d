"""Products that keep a part of their cells, against the dense form."""

import numpy as np
import pytest

from pagelib.operators import vectors as vec


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(12)
    rows = lambda n, name: spark.createDataFrame(
        [(f"{name}{i:04d}", x.tolist()) for i, x in enumerate(rng.standard_normal((n, 6)) * 0.3 + 0.2)], "id string, vector array<double>")
    return rows(400, "p"), rows(30, "t")


@pytest.fixture
def small_blocks(monkeypatch):
    for f in (vec.blocked_products, vec.product_moments):
        monkeypatch.setattr(f, "__defaults__", (*f.__defaults__[:-1], 64))


def test_moments_equal_the_dense_ones(sides, small_blocks):
    pages, tags = sides
    dense = vec.blocked_products(pages, tags).toPandas().groupby("right")["score"]
    got = vec.product_moments(pages, tags).toPandas().set_index("id").sort_index()
    assert (got["n"] == 400).all()
    assert np.allclose(got["mean"], dense.mean().sort_index(), atol=1e-12) and np.allclose(got["sd"], dense.std(ddof=0).sort_index(), atol=1e-12)


@pytest.mark.parametrize("with_images", [False, True])
def test_zero_shot_keeps_the_best_and_the_predicted(sides, small_blocks, with_images):
    pages, tags = sides
    images = pages.where("id < 'p0150'").selectExpr("id", "transform(vector, x -> 1 - x) AS vector") if with_images else None
    queries = tags.withColumnRenamed("id", "tag")
    dense = vec.zero_shot(pages, queries, images, 1.5).toPandas().sort_values(["id", "score", "tag"], ascending=[True, False, True])
    place = dense.groupby("id").cumcount()
    want = {(r.id, r.tag): (round(r.score, 7), r.predicted) for r in dense[(place < 3) | dense["predicted"]].itertuples()}
    got = {(r["id"], r["tag"]): (round(r["score"], 7), r["predicted"]) for r in vec.zero_shot(pages, queries, images, 1.5, k=3).collect()}
    assert got == want and len(want) < len(dense) / 2 and any(p for _, p in want.values())


def test_floors_hold_at_equal_scores(spark):
    pages = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<double>")
    tags = spark.createDataFrame([("a", [0.5, 0.5], 0.5), ("b", [1.0, 0.0], 2.0), ("c", [0.25, 0.0], None)], "id string, vector array<double>, floor double")
    got = sorted((r["left"], r["right"], r["clears"]) for r in vec.blocked_products(pages, tags, 1).collect())
    assert got == [(1, "a", True), (1, "b", False), (2, "a", True)]
    assert vec.blocked_products(pages.limit(0), tags, 1).collect() == []
