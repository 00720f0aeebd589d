"""Ranked search against brute force, and how much of it the bounds save."""

import math
import random
import re
from collections import Counter

import pytest

from pagelib.llm import ranked

WORD = re.compile(ranked.TERM)


def terms(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    total, n = sum(sum(c.values()) for _, c in held), len(held)
    df = Counter(w for _, c in held for w in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        scored = []
        for doc_id, c in held:
            m = 100 - 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 20 * m)) for w in words if w in c)
            if s > 0:
                scored.append((-s, doc_id is None, doc_id))
        out += [(item, r + 1, doc_id, -s) for r, (s, _, doc_id) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, k):
    index = ranked.index_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    return sorted((tuple(r) for r in ranked.search(index, spark.createDataFrame(items, "item_id long, text string"), k).collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    random.seed(5)
    words = [f"w{i}" for i in range(300)]
    rare = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(random.choices(words, rare, k=random.randint(1, 60)))) for i in range(500)]
    docs += [(1000 + i, docs[3][1]) for i in range(80)]                     # a group of copies, tied
    docs += [(2, docs[2][1]), (None, docs[2][1]), (None, "w1 W2,w2-w3"), (9000, None), (9001, ""), (9002, " ,.;\n"), (9003, "Ärger w1 é 中文w2")]
    items = [(i, " ".join(random.choices(words, k=12))) for i in range(20)]
    items += [(50, docs[3][1]), (51, docs[2][1]), (52, "ärger Ärger w1"), (53, ""), (54, None), (55, "unknown"), (None, "w2"), (50, "w7")]
    return docs, items


@pytest.mark.parametrize("k", [1, 10, 1000])
def test_search_equals_brute_force(spark, corpus, k):
    docs, items = corpus
    assert found(spark, docs, items, k) == brute(docs, items, k)


@pytest.mark.parametrize("shard_docs", [7, 64, 100_000])
def test_shards_of_any_size(monkeypatch, corpus, shard_docs):
    """The tasks' own functions, run here so that small shards and their carried k-th scores count."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(ranked, "SHARD_DOCS", shard_docs)
    docs, items = corpus
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs], pa.string())], names=["doc_id", "text"])
    rows = list(ranked.shards(iter([batch])))
    n, words = sum(r.column(0)[0].as_py() for r in rows), sum(r.column(1)[0].as_py() for r in rows)
    df = Counter()
    for r in rows:
        df.update(dict(zip(r.column(3)[0].as_py(), r.column(4)[0].as_py())))
    known = sorted(df)
    number = {w: i for i, w in enumerate(known)}
    asked = [(i, np.array(sorted({number[w] for w in terms(t) if w in number}), dtype=int)) for i, t in items if i is not None and i < 50]
    weights = np.array([ranked.weight(n, df[w]) for w in known])
    want = brute(docs, [(i, t) for i, t in items if i is not None and i < 50], 5)
    for least in ({}, {i: (s, d) for i, r, d, s in want if r == 5}):
        got = []
        for b in ranked.searcher(asked, known, weights, 5, n, words, least)(iter(rows)):
            got += sorted(b.to_pylist(), key=lambda r: (-r["score"], r["doc_id"] is None, r["doc_id"] or 0))
        for item, _ in asked:
            mine = [(r["doc_id"], r["score"]) for r in got if r["item_id"] == item]
            assert mine == [(d, s) for i, r, d, s in want if i == item and (not least or r < 5 or item not in least)]


def test_bounds_save_most_documents():
    import numpy as np
    import pyarrow as pa

    random.seed(6)
    docs = [(i, " ".join(random.choices([f"t{i % 40}x{j}" for j in range(50)] + ["the", "of"] * 10, k=40))) for i in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([t for _, t in docs])], names=["doc_id", "text"])
    row, = ranked.shards(iter([batch]))
    n, words = row.column(0)[0].as_py(), row.column(1)[0].as_py()
    known, df = row.column(3)[0].as_py(), row.column(4)[0].as_py()
    columns = {"ids": row.column(2)[0].values.to_numpy(), "terms": row.column(3)[0].values, "counts": row.column(4)[0].values.to_numpy()}
    columns |= {c: np.frombuffer(row.column(c)[0].as_buffer(), dtype=np.int32) for c in ("lengths", "posting_doc", "posting_count")}
    shard = ranked.SearchShard(columns, pa.array(known), np.array([ranked.weight(n, d) for d in df]), n, words)
    none = np.empty(0, dtype=np.int64)
    shard.best(np.array([known.index(w) for w in ("the", "of", "t3x1", "t3x2", "t3x3", "t3x4")]), 10, none, none)
    assert shard.scored < 400


def test_blocks_of_items(spark, monkeypatch, corpus):
    monkeypatch.setattr(ranked, "ITEMS", 6)
    docs, items = corpus
    assert found(spark, docs, items, 4) == brute(docs, items, 4)


def test_empty_tables(spark, nothing, awkward):
    one = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert ranked.search(ranked.index_documents(nothing), one).collect() == []
    assert ranked.search(ranked.index_documents(awkward), one.limit(0)).collect() == []
    river = spark.createDataFrame([(1, "river", "x"), (2, None, "x")], "item_id long, text string, doc_id string")
    assert [r.doc_id for r in ranked.search(ranked.index_documents(awkward), river).collect()] == [1, 2, 2, 10]
