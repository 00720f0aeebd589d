import numpy as np
from pyspark.sql import functions as F

from pagelib.functions import heads
from pagelib.operators import evaluate, models


def data(n=240, d=6, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * [1, 5, 0.2, 1, 1, 1][:d] + 3
    y = (x[:, 0] + 5 * x[:, 2] + rng.standard_normal(n) > 20).astype(float)
    y[:5] = 1
    return x, y


def test_logistic_is_at_the_minimum():
    x, y = data()
    best = heads.fit_logistic(x, y, 0.1)
    mean, sd = x.mean(0), x.std(0)
    weight = 0.1 * len(y) / 2 * np.where(y == 1, 1 / y.sum(), 1 / (1 - y).sum())

    def loss(head):
        w = head[:-1] * sd
        return (weight * np.logaddexp(0, -(2 * y - 1) * (x @ head[:-1] + head[-1]))).sum() + w @ w / 2

    rng = np.random.default_rng(2)
    assert all(loss(best) <= loss(best + rng.standard_normal(len(best)) * s) for s in (1e-3, 1e-2, 0.1) for _ in range(50))


def test_measures_equal_the_table_forms(spark):
    rng = np.random.default_rng(3)
    s, y = np.round(rng.random(90), 2), rng.integers(0, 2, 90)
    rows = spark.createDataFrame([(1, float(a), int(b)) for a, b in zip(s, y)], "tag int, score double, y int")
    assert abs(heads.average_precision(s, y) - evaluate.average_precision(rows, ["tag"]).first()["ap"]) < 1e-12
    assert heads.best_threshold(s, y) == evaluate.best_threshold(rows, ["tag"]).first()["threshold"]


def test_selection_ignores_unlabelled_rows_and_held_out_labels(spark):
    x, y = data()
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    labels = spark.createDataFrame([(i, "yes" if t else "no") for i, t in enumerate(y)], "id int, tag string")
    noise = [(1000 + i, (np.random.default_rng(i).standard_normal(6) * 50).tolist()) for i in range(100)]
    plain = spark.createDataFrame(rows, "id int, vector array<double>")
    more = spark.createDataFrame(rows + noise, "id int, vector array<double>")
    a, rules_a = models.fit_tag_heads(plain, labels, plain)
    b, rules_b = models.fit_tag_heads(more, labels, plain)
    key = lambda df: {r["tag"]: (r["c"], round(r["threshold"], 9), round(r["ap"], 9)) for r in df.collect()}
    assert key(rules_a) == key(rules_b) and set(key(rules_a)) == {"yes", "no"}
    got = {r["id"]: r["score"] for r in a.where(F.col("tag") == "yes").collect()}
    assert len(got) == len(x) and np.mean([got[i] for i in np.flatnonzero(y)]) > np.mean([got[i] for i in np.flatnonzero(y == 0)]) + 0.05


def test_rare_tags_keep_their_heads_beyond_the_sample(spark):
    rng = np.random.default_rng(7)
    n = 4000
    x = rng.standard_normal((n, 4))
    tag = np.where(np.arange(n) % 200 == 3, "rare", np.where(x[:, 0] > 0, "a", "b"))      # 20 of 4,000
    x[tag == "rare", 2] += 4
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vector array<double>")
    labels = spark.createDataFrame([(i, str(t)) for i, t in enumerate(tag)] + [(i, "few") for i in range(9)], "id int, tag string")
    _, rules = models.fit_tag_heads(vectors, labels, vectors.limit(5), train_rows=400)
    small = {r["tag"]: r for r in rules.collect()}
    _, rules = models.fit_tag_heads(vectors, labels, vectors.limit(5))
    whole = {r["tag"]: r for r in rules.collect()}
    assert set(small) == set(whole) == {"rare", "a", "b"}
    assert all(abs(small[t]["ap"] - whole[t]["ap"]) < 0.15 for t in whole)      # unweighted, a rare tag would look common


def test_a_row_that_stands_for_three_counts_as_three():
    x, y = data()
    rows = np.where(np.arange(len(y)) % 3 == 0, 3, 1)
    again = np.repeat(np.arange(len(y)), rows)
    # The penalty is per row fitted.
    c = 0.1
    assert np.allclose(heads.fit_logistic(x, y, c * len(again) / len(y), rows=rows.astype(float)), heads.fit_logistic(x[again], y[again], c), atol=1e-6)
    s = np.round(x[:, 0], 1)
    assert abs(heads.average_precision(s, y, rows) - heads.average_precision(s[again], y[again])) < 1e-12
    assert heads.best_threshold(s, y, rows) == heads.best_threshold(s[again], y[again])
