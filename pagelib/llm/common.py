"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from pagelib.plans.registry import configure
from pagelib.session import materialise

# White space of every word rule here: space, tab, line feed, vertical tab, form feed, carriage return.
# `bytes.split()` cuts at exactly these, and `bytes.lower()` changes A-Z only.
WORD = r"[^\x20\x09-\x0D]+"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the library's settings, and batches of texts that leave a Python worker small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return configure(spark)


def query(name: str, sql: str | None = None):
    """Register `fn(spark, sf_dir) -> DataFrame`, with its SQL twin if SQL can express it."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepared(spark), sf_dir)

        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """Words between white space, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def small(df: DataFrame, rows: int) -> DataFrame:
    """`df` with a broadcast hint if it has been counted and holds at most `rows` rows, else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components: (node, component) with the smallest node reachable, for every node of an edge.

    `edges` has long columns a and b. Each round turns every node's neighbourhood into a star around its smallest
    member (larger nodes first, then smaller ones), so the rounds grow with the logarithm of a component's length.
    A node with many links sends sums of its links only: the minimum combines before the shuffle. Each round is
    written to the shared folder, which cuts lineage and survives lost executors.
    """
    links = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .distinct(), name)
    while True:
        before = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        both = links.union(links.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # Larger neighbours of a node move to the smallest node around it.
        large = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        links = materialise(large, name)
        low = links.groupBy("a").agg(F.min("b").alias("m"))
        # Smaller neighbours and the node itself move to the smallest of them.
        pairs = links.join(low, "a")
        near = (pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
                .union(low.select("a", F.col("m").alias("b"))).distinct())
        links = materialise(near, name)
        if links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() == before:
            break
    return (links.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .union(links.select(F.col("b"), F.col("b")).distinct()))


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned from: crc32 of the id as text, mod 5, is 0. A null id is held out too."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(doc_id, text, label) of about `bound` labelled rows at most, none held out, chosen by a hash of the id.

    Every labelled row has the same chance at every size. The chosen ids, bounded by `bound`, are broadcast, so the
    texts are not shuffled. Where an id has several labels the largest counts.
    """
    known = (labels.where(F.col(label).isNotNull() & ~held_out()).groupBy("doc_id")
             .agg(F.max(label).cast("int").alias("label")))
    n = known.count()
    lot = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20))
    chosen = known.where(lot < F.lit(int((1 << 20) * min(1.0, bound / max(n, 1)))))
    return docs.select("doc_id", "text").where("text is not null").join(small(chosen, 2 * bound), "doc_id")


@pandas_udf(LongType())
def passage_signature(texts: pd.Series) -> pd.Series:
    """Smallest hash of a text's five-word runs: near copies share it, other texts do not.

    Learning from one text of each signature keeps a group of copies from speaking for itself.
    """
    def low(text: str) -> int:
        w = text.lower().split()
        return min((crc32(" ".join(w[i:i + 5]).encode()) * 0x9E3779B1 & 0xFFFFFFFF for i in range(max(1, len(w) - 4))))

    return texts.map(low).astype("int64")


def distinct_passages(sample: DataFrame) -> DataFrame:
    """(text, label) of one row of each passage signature; the largest label stands."""
    return (sample.withColumn("copies", passage_signature("text")).groupBy("copies")
            .agg(F.max(F.struct("label", "text")).alias("x")).select("x.text", "x.label"))
