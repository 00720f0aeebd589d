"""Every operator on awkward rows and on empty tables."""

import pytest

import corpus_pipeline
from pagelib.llm import (jaccard, licenses, mixing, pseudolikelihood, quality, sentencepiece_codec, substrings, toxicity)
from pagelib.llm.common import QUERIES


def run(df):
    return [r.asDict() for r in df.collect()]


def operators(docs, labels):
    model = sentencepiece_codec.default_model()
    return {"mixing": mixing.mixed_texts(docs), "licenses": licenses.with_licenses(docs), "lm": pseudolikelihood.with_likelihood(docs),
            "jaccard": jaccard.jaccard_components(docs), "one": jaccard.one_of_each(docs), "substrings": substrings.without_repeats(docs),
            "pieces": sentencepiece_codec.with_codes(docs, model, keep_text=True), "quality": quality.with_quality(docs, labels),
            "toxicity": toxicity.with_toxicity(docs, labels)}


def test_empty_tables(nothing, labels):
    for name, df in operators(nothing, labels).items():
        assert run(df) == [], name
    for name, df in operators(nothing, labels.limit(0)).items():
        assert run(df) == [], name


def test_no_labels(awkward, labels):
    none = labels.limit(0)
    assert {r["toxicity"] for r in run(toxicity.with_toxicity(awkward, none))} == {0.0}
    assert {r["quality_score"] for r in run(quality.with_quality(awkward, none))} == {0.5}


def test_rows_and_columns_stay(awkward, labels):
    n = awkward.count()
    for name, df in operators(awkward, labels).items():
        rows = run(df)
        if name not in ("mixing", "one"):
            assert len(rows) == n, name
        if name != "jaccard":
            assert set(awkward.columns) <= set(df.columns) and len(set(df.columns)) == len(df.columns), name


def test_empty_texts_have_defined_results(awkward, labels):
    blank = lambda rows: [r for r in rows if r["doc_id"] in (3, 4)]
    got = operators(awkward, labels)
    assert all((r["n_tokens"], r["log_likelihood"], r["score"]) == (0, 0, 0) for r in blank(run(got["lm"])))
    assert all((r["n_words"], r["n_base"], r["first_word"], r["labels"], r["score"]) == (0, 0, None, "", 0) for r in blank(run(got["licenses"])))
    assert all((r["n_tokens"], r["decoded"]) == (0, "") for r in blank(run(got["pieces"])))
    assert all(r["toxicity"] == 0 for r in blank(run(got["toxicity"])))
    assert {r["doc_id"]: r["text"] for r in blank(run(got["substrings"]))} == {3: None, 4: ""}
    assert all((r["n_shingles"], r["component_id"]) == (0, r["doc_id"]) for r in run(got["jaccard"]) if r["doc_id"] in (3, 4, 5))


@pytest.mark.parametrize("stages", [corpus_pipeline.STAGES])
def test_pipeline_stages_take_awkward_rows(spark, awkward, nothing, labels, tmp_path, stages):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (awkward, nothing):
        for name, stage in stages:
            docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), stage(spark, docs, str(tmp_path)).schema)
            if name != stages[-1][0]:
                assert docs.columns == corpus_pipeline.COLUMNS, name


def test_names_of_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
