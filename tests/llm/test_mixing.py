import pandas as pd
import pytest

from pagelib.llm import mixing
from pagelib.llm.common import QUERIES

FOLDER = "/root/testdata/sf0.001"


def fixed_point(sizes, weights):
    """Targets by handing the excess out again until none is above its cap."""
    total, capped = float(sum(sizes)), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(3 * sizes[i] for i in capped)
        share = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free} if free else {}
        over = {i for i in free if share[i] > 3 * sizes[i]}
        if not over:
            return [3.0 * sizes[i] if i in capped else share[i] for i in range(len(sizes))]
        capped |= over


def test_targets_are_the_fixed_point(spark):
    sizes = [900, 5, 40, 0, 1, 300, 7, 60]
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = fixed_point(sizes, [(1, 2, 3)[i % 3] for i in range(len(sizes))])
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(want)


def test_query_takes_its_targets(spark):
    df = QUERIES["op1_mixing"](spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas()
    got = df.toPandas()
    assert len(got) == len(docs)
    m = got.merge(docs[["doc_id", "source", "text"]], on="doc_id")
    assert (m["size"] == [len(t.encode().split()) for t in m["text"]]).all()
    assert (m["taken"] <= 3 * m["size"]).all() and (m["taken"] >= 0).all()
    by = m.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), said=("source_size", "first"))
    assert (by["size"] == by["said"]).all() and (by["taken"] - by["target"]).abs().max() <= 0.5
    again = QUERIES["op1_mixing"](spark, FOLDER).toPandas()
    key = ["doc_id", "size", "taken"]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), again.sort_values(key).reset_index(drop=True))


def test_slices_are_disjoint_and_shards_even(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    laid, slices = mixing.mix(docs, shards=8, blocks_per_shard=16)
    s = slices.toPandas().sort_values(["source_no", "epoch", "start", "first_word"])
    at = s["start"] + s["first_word"]
    same = (s["source_no"] == s["source_no"].shift()) & (s["epoch"] == s["epoch"].shift())
    assert (at[same] >= (at + s["n_words"]).shift()[same]).all()
    assert s["shard"].nunique() == 8
    by = s.groupby("shard")["n_words"].sum()
    assert by.max() < 2 * by.min()


def test_tree_counts_are_exact(spark):
    drawn = spark.createDataFrame([(i % 3 + 1, d) for i in range(3) for d in range(1, 41 * (i + 1))], "source_no int, draw long")
    owned = mixing.splitting_tree(drawn, 8, 1).toPandas()
    n = drawn.groupBy("source_no").count().toPandas().set_index("source_no")["count"]
    assert ((owned["last"] - owned["first"] + 1).groupby(owned["source_no"]).sum() == n).all()
    sizes = (owned["last"] - owned["first"] + 1).groupby(owned["shard"]).sum()
    assert sizes.max() - sizes.min() <= 1


def test_mixed_texts_hold_the_taken_words(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    _, slices = mixing.mix(docs)
    want = slices.groupBy("doc_id").sum("n_words").toPandas().set_index("doc_id")["sum(n_words)"]
    got = mixing.mixed_texts(docs).toPandas()
    assert (got["text"].map(lambda t: len(t.encode().split())).groupby(got["doc_id"]).sum().sort_index() == want.sort_index()).all()
    texts = docs.toPandas().set_index("doc_id")["text"]
    whole = got["text"].map(lambda t: len(t.split())) == got["doc_id"].map(texts).map(lambda t: len(t.split()))
    assert whole.any() and (got.loc[whole, "text"] == got.loc[whole, "doc_id"].map(texts)).all()
