"""Each stage of the pipeline against brute force on its own input, and the whole run."""

import hashlib

import pytest

import corpus_pipeline
from pagelib.llm import sentencepiece_codec, substrings, toxicity
from pagelib.llm.common import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, FOLDER), "test-stage")
        out.append(docs)
    return [d.toPandas() for d in out]


def test_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "source_mixing", "sentencepiece"]
    assert all(list(s.columns) == corpus_pipeline.COLUMNS for s in steps[:-1])


def test_toxic_documents_go(spark, steps):
    score = {r["doc_id"]: r["score"] for r in QUERIES["op10_toxicity"](spark, FOLDER).collect()}
    assert set(steps[1]["doc_id"]) == {d for d in steps[0]["doc_id"] if score[d] < toxicity.CUT}
    assert steps[1].set_index("doc_id")["text"].equals(steps[0].set_index("doc_id")["text"].loc[steps[1]["doc_id"]])


def test_one_of_each_group_stays(steps):
    rows = sorted(zip(steps[1]["doc_id"], steps[1]["text"]))
    sets = []
    for _, t in rows:
        w = t.encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    assert sorted(steps[2]["doc_id"]) == sorted(rows[i][0] for i in range(len(rows)) if group[i] == i)


def test_repeats_are_cut(steps):
    rows = sorted(zip(steps[2]["doc_id"], steps[2]["text"]))
    first = {}
    for d, t in rows:
        for i, h in enumerate(substrings.run_hashes(substrings.sentences(t)).tolist()):
            first.setdefault(h, (d, i))
    got = steps[3].set_index("doc_id")
    for d, t in rows:
        later = [i for i, h in enumerate(substrings.run_hashes(substrings.sentences(t)).tolist()) if first[h] != (d, i)]
        assert got.loc[d, "text"] == substrings.remove_runs(t, later)[0]
        assert got.loc[d, "n_chars"] == len(got.loc[d, "text"])


def test_mix_reaches_its_targets(steps):
    count = lambda s: s.map(lambda t: len(t.encode().split()))
    given, mixed = steps[3], steps[4]
    size = count(given["text"]).groupby(given["source"]).sum().sort_index()
    took = count(mixed["text"]).groupby(mixed["source"]).sum().reindex(size.index, fill_value=0)
    weight = [(1, 2, 3)[i % 3] for i in range(len(size))]
    low, high = 0.0, float(size.sum())
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3 * s, w * mid) for s, w in zip(size, weight)) < size.sum() else (low, mid)
    assert all(abs(t - min(3 * s, w * high)) <= 0.51 for t, s, w in zip(took, size, weight))
    own = count(given.set_index("doc_id")["text"])
    assert (count(mixed["text"]).groupby(mixed["doc_id"]).sum() <= 3 * own.loc[sorted(set(mixed["doc_id"]))]).all()


def test_codes_are_the_library_s(steps):
    sp = sentencepiece_codec.Codec(sentencepiece_codec.default_model()).processor
    want = sorted((d, len(ids := sp.encode(t)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                   hashlib.sha256(sp.decode(ids).encode()).hexdigest()) for d, t in zip(steps[4]["doc_id"], steps[4]["text"]))
    last = steps[5]
    assert sorted(zip(last["doc_id"], last["n_tokens"], last["ids_sha256"], last["decoded_sha256"])) == want


def test_run_is_the_stages_in_order(spark, steps):
    rows = lambda df: sorted(map(tuple, df.astype(object).values.tolist()))
    assert rows(corpus_pipeline.run(spark, FOLDER).toPandas()) == rows(steps[5])
