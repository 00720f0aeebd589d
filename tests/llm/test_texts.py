"""Operators on texts against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from pagelib.llm import licenses, pseudolikelihood, quality, sentencepiece_codec as pieces, substrings, toxicity
from pagelib.llm.common import QUERIES

FOLDER = "/root/testdata/sf0.001"
PASSAGE = ("The river rose in the night. Nobody on the farm had heard the rain. By morning the lower fields were a lake, and the "
           "gates stood open to it. The cattle had gone up to the ridge by themselves. They came down only when the water had left, "
           "three days later, thin and loud.")


@pytest.fixture(scope="module")
def texts(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas().set_index("doc_id")["text"]


def test_codec_equals_the_library(texts):
    codec = pieces.Codec(pieces.default_model())
    random.seed(4)
    parts = ["a", "the", "ing", " ", "  ", "\n", "é", "中", "😀", "▁", "19", ".", "!!", "ا", "\u0000", "²."]
    cases = ["".join(random.choices(parts, k=random.randint(0, 25))) for _ in range(3000)] + [" " * n + "x" for n in range(40)]
    for t in [*cases, *texts, "=" * 999, "ab" * 5000]:
        assert codec.encode(t) == codec.processor.encode(t), repr(t[:80])


def test_codes_query(spark, texts):
    codec = pieces.Codec(pieces.default_model())
    for r in QUERIES["op6_sentencepiece"](spark, FOLDER).collect():
        ids = codec.processor.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(codec.processor.decode(ids).encode()).hexdigest())


def test_license_base_places(spark, texts):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in QUERIES["op2_licenses"](spark, FOLDER).collect():
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), texts[r["doc_id"]]))
        places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (
            len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_license_templates_with_a_few_wrong_words():
    index = licenses.Index({})
    for name, (text, _) in licenses.TEMPLATES.items():
        words = f"some words before {text} and some after".encode().split()
        assert index.matches(words)[name] == 1.0
    words = licenses.TEMPLATES["isc"][0].replace("hereby", "herewith").encode().split()
    assert 0.9 < index.matches(words)["isc"] < 1
    broken = licenses.TEMPLATES["isc"][0].replace("with or without fee", "with or without pay").encode().split()
    assert "isc" not in index.matches(broken)      # its mandatory phrase is gone


def test_substrings_equal_brute_force(spark, texts):
    rows = list(texts.items())
    seen = {}
    for d, t in sorted(rows):
        for i, h in enumerate(substrings.run_hashes(substrings.sentences(t)).tolist()):
            seen.setdefault(h, (d, i))
    got = {r["doc_id"]: (r["text"], r["n_sentences"], r["n_removed"], r["words_removed"])
           for r in QUERIES["op5_substrings"](spark, FOLDER).collect()}
    for d, t in rows:
        later = [i for i, h in enumerate(substrings.run_hashes(substrings.sentences(t)).tolist()) if seen[h] != (d, i)]
        assert got[d] == substrings.remove_runs(t, later), d


def test_pasted_passage_goes_from_later_texts_only(spark):
    rows = [(i, f"Own beginning of text {i} without a stop {PASSAGE} Then text {i} goes its own way.") for i in range(40)]
    rows += [(100 + i, f"Clean text {i} says nothing that others say, {i * 7} times. The end of {i} is near.") for i in range(40)]
    got = {r["doc_id"]: r for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    assert got[0]["text"] == texts[0] and all(got[i]["text"] == texts[i] for i in range(100, 140))
    for i in range(1, 40):
        assert "cattle" not in got[i]["text"] and "river" not in got[i]["text"]
        assert got[i]["text"].startswith(f"Own beginning of text {i} without a stop") and got[i]["text"].endswith(f"Then text {i} goes its own way.")


def test_license_templates_with_a_word_more_or_less():
    index = licenses.Index({})
    bsd = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice."""
    assert licenses.scan_text(index, f"Copyright (c) 1999, X. {bsd}")[5] == "bsd"
    for name, (text, phrases) in licenses.TEMPLATES.items():
        w = text.split()
        middle = sorted(range(1, len(w)), key=lambda i: abs(i - len(w) // 2))
        held = lambda t: all(f" {p} " in f" {t} " for p in phrases)
        more = next(t for i in middle if held(t := " ".join([*w[:i], "oddword", *w[i:]])))
        less = next(t for i in middle if held(t := " ".join([*w[:i], *w[i + 1:]])))
        assert index.matches(f"before {more} after".encode().split())[name] == 1.0, name
        assert index.matches(f"before {less} after".encode().split())[name] == (len(w) - 1) / len(w), name
        backwards = " ".join(reversed(w)) + " " + " ".join(phrases)
        assert name not in index.matches(backwards.encode().split()), name


def shared_windows(texts, n=51):
    """(text, word) of each window of n words that an earlier place holds too; knows nothing of sentences."""
    first, out = {}, []
    for d, t in texts:
        w = t.split()
        for i in range(len(w) - n + 1):
            if first.setdefault(tuple(w[i:i + n]), (d, i)) != (d, i):
                out.append((d, i))
    return out


def test_passages_merged_at_both_ends_lose_every_whole_run(spark):
    rng = random.Random(5)
    line = lambda n: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))
    rows, inner = [], {}
    for p in range(30):
        mid = [line(12) + "." for _ in range(3)]     # 36 words in whole sentences, 56 with both ends
        passage = f"{line(10)}. {' '.join(mid)} {line(10)}"
        for k in range(3):
            d = 3 * p + k
            rows.append((d, f"{line(20)}. {line(4)} {passage} {line(4)}. {line(20)}."))
            inner[d] = " ".join(mid).split(), passage.split()
    assert len({d for d, _ in shared_windows(rows)}) == 60
    got = {r["doc_id"]: r for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert shared_windows([(d, got[d]["text"]) for d, _ in rows]) == []
    for d, t in rows:
        gone = set(t.split()) - set(got[d]["text"].split())
        if d % 3 == 0:
            assert got[d]["text"] == t
        else:     # whole sentences go, of the merged ones at most words of the passage, and nothing around it
            assert set(inner[d][0]) <= gone <= set(inner[d][1]) and got[d]["words_removed"] == len(gone)


NAMES = ["My aunt once sued the New York City Council over a fence.", "Gestern traf Anna Maria Schmidt den Herrn Doktor Hans Peter Müller am Bahnhof Friedrichstraße.",
         "Chapter One\nThe Long Way Home\n\n", "| 1 | apples | 2.50 |\n| 2 | pears | 3.10 |\n| 3 | plums | 4.00 |\n", "1.\n2.\n3.\n4.\n5.\n",
         "12 Green Lane\nSpringfield\nSP1 4XY\nGreat Britain\n", "Dr. A. B. Smith, Prof. C. D. Jones, Mr. E. F. White. "]


def test_names_headings_and_rows_stay(spark):
    rng = random.Random(8)
    line = lambda n: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))
    rows = [(20 * i + k, f"{line(12)}. {name} {line(15)}. {line(9)}") for i, name in enumerate(NAMES) for k in range(12)]
    rows += [(1000 + k, f"{line(9)} the New York City Council {line(9)} the New York City Council met. {line(5)}") for k in range(9)]
    got = {r["doc_id"]: r for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: r["text"] for d, r in got.items()} == dict(rows)


def test_least_words_is_a_parameter(spark):
    rows = [(i, f"w{i}a w{i}b w{i}c. One two three. Four five six. Seven eight nine. w{i}d w{i}e.") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["n_removed"] for r in substrings.without_repeats(df).orderBy("doc_id").collect()] == [0, 0, 0]
    assert [r["n_removed"] for r in substrings.without_repeats(df, least_words=9).orderBy("doc_id").collect()] == [0, 3, 3]
    assert [r["n_removed"] for r in substrings.without_repeats(df, least_words=10).collect()] == [0, 0, 0]


def test_null_ids_come_first_and_lose_only_repeats(spark):
    texts = [f"Own {i} words here. {PASSAGE} End of {i}." for i in range(30)]
    rows = [(None, t) for t in texts] + [(1, texts[0]), (2, "Own text alone.")]
    got = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["n_removed"] == 0 for r in got if r["doc_id"] is None) == 1 and len(got) == 32
    assert {r["doc_id"]: r["n_removed"] > 0 for r in got if r["doc_id"] is not None} == {1: True, 2: False}


@pytest.mark.parametrize("script", ["lower case", "table", "chinese", "chinese with stops", "periodic"])
def test_passages_at_any_offset_of_long_sentences(spark, script):
    rng = random.Random(6)
    unspaced = script.startswith("chinese")

    def line(n):
        if unspaced:
            w = [chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(n)]
            return "".join(c + "。" * (script.endswith("stops") and i % 9 == 8) for i, c in enumerate(w))
        if script == "periodic":
            return " ".join(("x", "y", "z")[i % 3] for i in range(n))
        return " ".join(str(rng.randrange(10 ** 6)) if script == "table" else f"w{rng.randrange(10 ** 6)}" for _ in range(n))

    own = lambda n: line(n) if script != "periodic" else " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))
    gap = "" if unspaced else " "
    passage = line(90)
    rows = [(d, gap.join([own(20 + d), passage, own(30)])) for d in range(33)]
    got = {r["doc_id"]: r for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    spaced = lambda t: " ".join(t) if unspaced else t
    assert got[0]["text"] == rows[0][1] or script == "periodic"    # a periodic passage repeats itself
    assert {d for d, _ in shared_windows([(d, spaced(t)) for d, t in rows])} >= set(range(1, 33))
    assert shared_windows([(d, spaced(got[d]["text"])) for d, _ in rows]) == []
    for d, t in rows[1:]:
        head, tail = t.split(passage)
        assert got[d]["text"].startswith(head[:len(head) // 2]) and got[d]["text"].endswith(tail[-len(tail) // 2:])


def test_sentences_of_other_scripts_cover_the_text():
    for t in ["他说：“走吧。”然后走了！？再见。 好", "私は行く。君も「行く。」と言う。", "สวัสดี ครับ", "यह है। वह है। end", "。", "a。b.c D", "\n。\n"]:
        parts = substrings.sentences(t)
        assert "".join(t[a:b] for a, b, _ in parts) == t[parts[0][0]:]
        assert "".join(w for _, _, ws in parts for w in ws) == "".join(t.split())
    assert len(substrings.sentences("一二三。四五六！七八九？")) == 3


def test_sentences_cover_the_text(texts):
    for t in texts:
        parts = substrings.sentences(t)
        assert "".join(t[a:b] for a, b, _ in parts) == t[parts[0][0]:] if parts else not t.split()
        assert [w for _, _, ws in parts for w in ws] == t.split()


def test_runs_flush_and_stream_in_pieces(spark, monkeypatch):
    """Small buffers and batches give the same answer."""
    rows = [(i, f"Head {i}. {PASSAGE} Tail {i}.") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        small = sorted(substrings.without_repeats(df).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert small == sorted(substrings.without_repeats(df).collect())
    assert sum(r["n_removed"] > 0 for r in small) == 299


def auc(y, s):
    r = pd.Series(s).rank().to_numpy()
    n = y.sum()
    return (r[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize("name,label,least", [("op7_quality", "quality", 0.95), ("op10_toxicity", "toxic", 0.75)])
def test_held_out_accuracy(spark, name, label, least):
    folder = "/root/testdata/sf0.01"
    got = QUERIES[name](spark, folder).toPandas().merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert ((got["score"] >= 0) & (got["score"] <= 1)).all()
    assert auc(held[label].to_numpy(), held["score"].to_numpy()) > least


def test_restored_words(spark):
    model = toxicity.character_model(spark.createDataFrame([("the idiot is a stupid loser and the scum of trash " * 40,)], "text string"))
    for seen, meant in [("1d10t", "idiot"), ("$tup!d", "stupid"), ("l0ser", "loser"), ("s.c.u.m", "scum"), ("trrrash", "trash")]:
        assert toxicity.features_of(seen, model)[0] == meant
    assert "stupid" in toxicity.words_of("you are s t u p i d today")
    assert toxicity.features_of("plain", model)[0] == "plain"


def test_viterbi_equals_enumeration(spark):
    model = toxicity.character_model(spark.createDataFrame([("some loose letters stay lost in the forest " * 9,)], "text string"))

    def score(parts):
        text = "".join(t for t, _ in parts)
        ids = [0, 0, *map(toxicity.letter, text), 0]
        return sum(c for _, c in parts) + sum(model[a, b, c] for a, b, c in zip(ids, ids[1:], ids[2:]))

    for word in ["l00s3", "f0r3ss7", "1e77er", "s-t@y"]:
        paths = [[]]
        for c, n in toxicity.runs_of(word):
            paths = [p + [o] for p in paths for o in toxicity.readings(c, n)]
        best = max(map(score, paths))
        text = toxicity.restore(word, model)
        assert any("".join(t for t, _ in p) == text and score(p) == pytest.approx(best) for p in paths)


def test_likelihood_beats_word_counts_and_falls_for_shuffled_text(spark):
    rng = np.random.default_rng(0)
    lines = [" ".join(f"{'ab'[k % 2]}{k % 2}" for k in range(60)) for _ in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    words = pseudolikelihood.vocabulary(docs)
    net = pseudolikelihood.train(docs, words, rounds=4)
    odd = " ".join(rng.permutation(lines[0].split()))
    scored = docs.limit(1).union(spark.createDataFrame([(-1, odd)], docs.schema))
    got = {r["doc_id"]: r["s"] for r in scored.withColumn("s", pseudolikelihood.scorer(docs, words, net)("text")).collect()}
    assert got[0]["score"] > 0.6 > 0.5 > got[-1]["score"] and got[0]["n_tokens"] == 60


def test_rare_words_score_by_their_own_counts(spark, monkeypatch):
    """Every word's probability in its place is its class's times its own share of the corpus counts."""
    monkeypatch.setattr(pseudolikelihood, "WORDS", 64)
    rng = np.random.default_rng(4)
    common = [f"c{i}" for i in range(64)]
    lines = [" ".join(rng.choice(common, 40)) + " " + " ".join(f"r{rng.integers(300)}" for _ in range(4)) for _ in range(200)]
    lines += ["start seldom end", "start often end"] + ["often"] * 30 + ["start seldom end"] + ["Café 中文 often"] * 2
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    counts = pd.Series([w for t in lines for w in t.lower().split()]).value_counts()
    words = pseudolikelihood.vocabulary(docs)
    assert words.size == max(64, int(counts.sum() ** 0.5))
    net = pseudolikelihood.train(docs, words)
    got = pseudolikelihood.with_likelihood(docs).toPandas().set_index("doc_id")
    for d, t in enumerate(lines):
        context, word, _ = pseudolikelihood.windows([words.places_of(t.lower().split())], words.places)
        z = net.forward(context)[2]
        want = 0.0
        for k, w in enumerate(t.lower().split()):
            g = words.group[word[k]]
            inside = (words.n + 0.1)[words.group == g].sum()
            p = (words.n[word[k]] + 0.1) / inside * (counts[w] / words.n[word[k]])
            want += z[k, g] + np.log(p)
        assert got.loc[d, "log_likelihood"] == pytest.approx(want, rel=1e-4), t
        assert got.loc[d, "score"] == pytest.approx(np.exp(want / len(t.split())), rel=1e-3)


def test_likelihood_cuts_a_text_twice_and_takes_each_exp_once(spark, monkeypatch):
    """Places and rare words are stored: the result reads no text again. A step takes the exp of each class of a window once."""
    assert not [f for f in QUERIES["op3_pseudolikelihood"](spark, FOLDER).inputFiles() if "documents.parquet" in f]
    taken, exp = [], np.exp
    monkeypatch.setattr(np, "exp", lambda x, **more: taken.append(np.size(x)) or exp(x, **more))
    size = pseudolikelihood.WORDS
    memory = {k: np.full(s, 1e-4, dtype=np.float32) for k, s in pseudolikelihood.shapes(size).items()}
    pseudolikelihood.Network(size=size).step(np.zeros((50, 4), dtype=np.int64), np.zeros(50, dtype=np.int64), memory)
    assert sum(taken) == 50 * pseudolikelihood.sizes(size)[2]


@pytest.mark.parametrize("scale", [1, 300])
def test_step_follows_the_gradient_of_the_log_loss(scale):
    """Also where logits are too large for exp."""
    size, rng = 64, np.random.default_rng(2)
    net = pseudolikelihood.Network(size=size)
    net.p["W2"] *= scale
    before = {k: v.astype(np.float64) for k, v in net.p.items()}
    context, group = rng.integers(0, 73, (40, 4)), rng.integers(0, 8, 40)

    def logs(p):
        h = np.tanh(p["E"][context].reshape(40, -1) @ p["W1"] + p["b1"])
        z = h @ p["W2"] + p["b2"]
        top = z.max(1, keepdims=True)
        return (z - top - np.log(np.exp(z - top).sum(1, keepdims=True)))[np.arange(40), group]

    assert net.log_probabilities(context, group) == pytest.approx(logs(before), rel=1e-4, abs=1e-3 * scale ** 0.5)
    memory = {k: np.zeros_like(v) for k, v in net.p.items()}
    net.step(context, group, memory)
    for k, at in [("E", (context[0, 1], 3)), ("W1", (5, 2)), ("b1", (7,)), ("W2", (4, group[0])), ("b2", (group[1],))]:
        moved = []
        for way in (1e-6, -1e-6):
            p = {n: v.copy() for n, v in before.items()}
            p[k][at] += way
            moved.append(-logs(p).mean())
        assert memory[k][at] ** 0.5 == pytest.approx(abs(moved[0] - moved[1]) / 2e-6, rel=1e-2, abs=1e-6), k


def test_coded_texts_hold_places_and_rare_words(spark, monkeypatch):
    """Across the end of a cache and of a chunk: each word's place, and hashes and counts of rare words once for equal texts of a task."""
    monkeypatch.setattr(pseudolikelihood, "WORDS", 8)
    monkeypatch.setattr(pseudolikelihood, "CACHE_WORDS", 10)
    rng = np.random.default_rng(5)
    lines = [" ".join(f"É{k}" for k in rng.integers(60, size=rng.integers(0, 30))) for _ in range(200)]
    lines += ["", " ", lines[0], lines[0]]
    words = pseudolikelihood.vocabulary(spark.createDataFrame([(t,) for t in lines], "text string"))
    codes = pseudolikelihood.Codes(words)
    for start in range(0, len(lines), 7):
        part = [pseudolikelihood.words_of(t) for t in lines[start:start + 7]]
        fresh = np.arange(len(part)) % 3 > 0
        place, n_rare, found, times, rare = pseudolikelihood.code_lines(codes, part, fresh)
        assert place.tolist() == [p for x in part for p in words.places_of(x).tolist()]
        ends = np.cumsum(rare)
        for i, x in enumerate(part):
            want = Counter(w for w in x if words[w] >= words.size)
            hashes = {pseudolikelihood.xxhash.xxh64_intdigest(w.encode(), 42): n for w, n in want.items()}
            own = slice(ends[i] - rare[i], ends[i])
            assert n_rare[i] == sum(want.values())
            assert dict(zip(found[own].view(np.uint64).tolist(), times[own].tolist())) == (hashes if fresh[i] else {})


def test_votes_equal_brute_force():
    rng = np.random.default_rng(1)
    counts = rng.poisson(0.2, (60, quality.WIDTH)).astype(np.float32)
    labels = rng.integers(0, 2, 60).astype(float)
    model = quality.Model(np.ones(quality.WIDTH), counts, labels)
    got = model.votes(counts[:9])
    for i in range(9):
        near = model.known @ model.latent(quality.damped(counts[i:i + 1], model.idf))[0]
        top = np.argsort(-near)[: quality.NEIGHBOURS]
        w = np.maximum(near[top], 0).astype(float) ** quality.SHARPNESS
        assert got[i] == pytest.approx((w @ labels[top] + 0.02 * labels.mean()) / (w.sum() + 0.02), rel=1e-4)
