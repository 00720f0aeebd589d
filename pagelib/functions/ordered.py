"""Order-dependent window functions that never hold one key's rows in one task.

A plain window puts a whole partition key in one task, and a window without a key
the whole table. Each function here takes `coarse`: expressions that never
decrease along `order` (an hour for a timestamp, `floor(score * 1000)` for a
score). Rows are windowed inside (keys, coarse), one summary row per bucket is
carried forward along the key, and the two are joined. Only bucket summaries of
a key meet in one task, and the result equals the plain window exactly.

The bucket is a pure function of the row, so a recomputed task agrees with the
first run; no sampled range bounds are involved.

Where no such expression spreads the rows (ranks, scores that most rows share), `number`
orders a whole table by borders that are data: Spark samples quantiles of the order itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagelib.session import materialise

PLACE_BITS = 33      # Spark numbers the rows of a partition below this bit, and the partition above it


class Coarse:
    """A bucket expression with the direction its order key runs in."""

    def __init__(self, expr: Column, descending: bool = False):
        self.expr = expr
        self.descending = descending


def _bucketed(df: DataFrame, coarse: Sequence[Coarse]):
    names = [f"__bucket{i}" for i in range(len(coarse))]
    df = df.withColumns({n: c.expr for n, c in zip(names, coarse)})
    order = [F.col(n).desc() if c.descending else F.col(n).asc() for n, c in zip(names, coarse)]
    return df, names, order


def _attach(local: DataFrame, carried: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    right = carried.select(*[F.col(c).alias(f"__r_{c}") for c in on], *values)
    cond = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on]
    return local.join(right, cond, "left").drop(*[f"__r_{c}" for c in on])


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], coarse: Sequence[Coarse],
            name: str, value: Column, how: str = "sum", inclusive: bool = True) -> DataFrame:
    """`how(value) over (partition by keys order by order rows unbounded preceding)`.

    `order` must be total within the keys. Exclusive means up to the row before.
    """
    agg = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    df, buckets, bucket_order = _bucketed(df, coarse)
    on = [*keys, *buckets]
    df = df.withColumn("__value", value)
    end = 0 if inclusive else -1
    rows = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = df.withColumn("__local", agg("__value").over(rows))
    summary = df.groupBy(*on).agg(agg("__value").alias("__bucket_value"))
    before = (Window.partitionBy(*keys).orderBy(*bucket_order)
              .rowsBetween(Window.unboundedPreceding, -1))
    carried = summary.withColumn("__carry", agg("__bucket_value").over(before))
    joined = _attach(local, carried, on, ["__carry"])
    if how == "sum":
        zero = F.lit(0).cast("long")
        total = F.coalesce("__carry", zero) + F.coalesce("__local", zero)
        either = total
    elif how == "max":
        either = F.greatest("__carry", "__local")
    else:
        either = F.least("__carry", "__local")
    return joined.withColumn(name, either).drop("__value", "__local", "__carry", *buckets)


def row_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
               coarse: Sequence[Coarse], name: str = "row") -> DataFrame:
    """`row_number() over (partition by keys order by order)` as a long."""
    return running(df, keys, order, coarse, name, F.lit(1).cast("long"))


def ranges(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """`df` dealt into ranges of `order` and sorted, in the shared folder; `__at` numbers a row within its range.

    `order` must be total over the table: ties are cut by its last keys, so a range holds a bounded share of the rows
    whatever they have in common. Borders are sampled, so the rows are written with their numbers: all readers see the same.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(dealt.withColumn("__at", F.monotonically_increasing_id()), "ranges")


def number(df: DataFrame, order: Sequence[Column], name: str = "row") -> DataFrame:
    """`row_number() over (order by order)` as a long, over a whole table and at any skew."""
    written = ranges(df, order).withColumn("__range", F.shiftright("__at", PLACE_BITS))
    # One row for each range, as many as there are shuffle partitions.
    sizes = written.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("__range").alias("__r"), F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__start"))
    within = F.col("__at").bitwiseAND((1 << PLACE_BITS) - 1)
    return (written.join(F.broadcast(starts), F.col("__range") == F.col("__r"))
            .withColumn(name, F.col("__start") + within + 1).drop("__at", "__range", "__r", "__start"))


def lag(df: DataFrame, keys: Sequence[str], order: Sequence[Column], by: Sequence[str],
        coarse: Sequence[Coarse], name: str, value: Column) -> DataFrame:
    """`lag(value) over (partition by keys order by order)`; `by` names the ascending order columns.

    Rows are shuffled once, without the value beside the columns it is made of. Only a bucket's first and last rows meet
    along the key, because the row before a bucket's first one is the last of an earlier bucket.
    """
    df, buckets, _ = _bucketed(df, coarse)
    on = [*keys, *buckets]
    inside = Window.partitionBy(*on).orderBy(*order)
    local = df.repartition(*on).withColumn("__value", F.struct(value.alias("v"))).withColumns({
        "__prev": F.lag("__value").over(inside), "__next": F.lead(F.lit(True)).over(inside)})
    edges = local.where(F.col("__prev").isNull() | F.col("__next").isNull()).withColumn("__first", F.col("__prev").isNull())
    edges = edges.withColumn("__prev", F.lag("__value").over(Window.partitionBy(*keys).orderBy(*by)))
    out = local.where(F.col("__prev").isNotNull()).unionByName(edges.where("__first").drop("__first"))
    return out.withColumn(name, F.col("__prev").getField("v")).drop("__value", "__prev", "__next", *buckets)


def id_bucket(column: str | Column, width: int = 1 << 20) -> Column:
    """Bucket of a non-negative whole number key."""
    c = F.col(column) if isinstance(column, str) else column
    return F.floor(c / F.lit(width))


def score_bucket(column: str | Column, per_unit: int = 4096) -> Column:
    """Bucket of a score; non-decreasing in it."""
    c = F.col(column) if isinstance(column, str) else column
    return F.floor(c * F.lit(per_unit))
