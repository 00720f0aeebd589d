"""Split window functions equal the plain ones, also when one key holds most rows."""

import random

from pyspark.sql import Window, functions as F

from pagelib.functions import ordered
from pagelib.functions.ordered import Coarse


def rows(spark):
    r = random.Random(7)
    data = [("hot" if r.random() < 0.7 else f"k{r.randrange(5)}", i, r.randrange(400), r.randrange(-5, 50)) for i in range(3000)]
    data += [(None, 5000 + i, i, i) for i in range(20)]
    return spark.createDataFrame(data, "k string, id long, at int, v int")


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_row_number(spark):
    df, order = rows(spark), [F.desc("at"), F.asc("id")]
    split = ordered.row_number(df, ["k"], order, [Coarse(F.floor(F.col("at") / 10), descending=True)], "n")
    plain = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(*order)).cast("long"))
    same(split.select("id", "n"), plain.select("id", "n"))


def test_running_sum_and_max(spark):
    df, order = rows(spark), [F.col("at"), F.col("id")]
    coarse = [Coarse(F.floor(F.col("at") / 7))]
    for inclusive, end in ((True, 0), (False, -1)):
        w = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        s = ordered.running(df, ["k"], order, coarse, "x", F.col("v").cast("long"), "sum", inclusive)
        same(s.select("id", "x"), df.select("id", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("x")))
        m = ordered.running(df, ["k"], order, coarse, "x", F.col("v"), "max", inclusive)
        same(m.select("id", "x"), df.select("id", F.max("v").over(w).alias("x")))


def test_lag(spark):
    df, order = rows(spark), [F.col("at"), F.col("id")]
    split = ordered.lag(df, ["k"], order, ["at", "id"], [Coarse(F.floor(F.col("at") / 25))], "p", F.col("v"))
    plain = df.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy(*order)))
    same(split.select("id", "p"), plain.select("id", "p"))


def test_lag_shuffles_rows_once_and_without_the_value(spark):
    df = spark.createDataFrame([(k, i, f"text {i}") for k in "ab" for i in range(40)], "k string, at long, text string")
    split = ordered.lag(df, ["k"], [F.col("at")], ["at"], [Coarse(F.floor(F.col("at") / 8))], "p", F.struct("text"))
    got = {(r.k, r.at): r.p and r.p.text for r in split.collect()}
    assert got == {(k, i): f"text {i - 1}" if i else None for k in "ab" for i in range(40)}
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    below = [line for i, line in enumerate(plan.splitlines()) if "RepartitionByExpression" in plan.splitlines()[i - 1]]
    assert below and not any("__value" in line for line in below)


def test_lag_over_buckets_of_one_row_and_null_values(spark):
    df = spark.createDataFrame([(None, 1, None), (None, 2, "x"), ("a", 5, "y"), ("a", 9, None), ("a", 10, "z")], "k string, at long, v string")
    split = ordered.lag(df, ["k"], [F.col("at")], ["at"], [Coarse(F.floor(F.col("at") / 2))], "p", F.col("v"))
    assert {(r.k, r.at): r.p for r in split.collect()} == {(None, 1): None, (None, 2): None, ("a", 5): None, ("a", 9): "y", ("a", 10): None}
