"""Periodic runs against brute force."""

import hashlib
import random
from zlib import crc32

import pytest

from pagelib.llm import runs
from pagelib.llm.common import QUERIES

FOLDER = "/root/testdata/sf0.001"


def brute(words, least_length=6, exponent=4):
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least_length, exponent * q):
                found.setdefault((i, j - i + q), q)      # the smallest period comes first
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def rows(found):
    return [tuple(map(int, r)) for r in found]


def collapse(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("limits", [(6, 4), (1, 2), (5, 3)])
def test_runs_equal_brute_force(limits):
    random.seed(7)
    for _ in range(1500):
        letters, n = random.choice([1, 2, 2, 3, 5]), random.randint(0, 60)
        words = [random.randrange(letters) for _ in range(n)]
        if random.random() < 0.5:
            words = []
            while len(words) < n:
                words += [random.randrange(letters) for _ in range(random.randint(1, 5))] * random.randint(1, 6)
        assert rows(runs.runs_of(words, *limits)) == brute(words, *limits), words


def test_long_stretches():
    random.seed(8)
    block = [random.randrange(60) for _ in range(500)]
    words = ["a", "b", *block * 9, "c", *["x"] * 3000, *(["x", "y"] * 400), "d"]
    assert rows(runs.runs_of(words)) == brute(words)
    assert rows(runs.runs_of(["w"] * 50_000)) == [(0, 50_000, 1)]


def test_a_run_needs_a_period_twice():
    with pytest.raises(ValueError):
        runs.runs_of(["a"] * 9, 6, 1)


def test_trees_agree_with_plain_suffixes():
    random.seed(9)
    for _ in range(200):
        s = [random.randint(1, 3) for _ in range(random.randint(1, 40))]
        for backward in (False, True):
            order, shared = runs.SuffixTree(s).tour(backward)
            key = (lambda i: [-x for x in s[i:]]) if backward else (lambda i: s[i:])
            assert order.tolist() == sorted(range(len(s) + 1), key=key)
            for a, b, n in zip(order, order[1:], shared[1:]):
                assert s[a:a + n] == s[b:b + n] and s[a + n:a + n + 1] != s[b + n:b + n + 1]


def planted(doc_id, words):
    h = crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in QUERIES["op11_runs"](spark, FOLDER).collect():
        words = planted(r.doc_id, [w.decode() for w in texts[r.doc_id].encode().split()])
        found = brute(words)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (
            len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapse(words, found).encode()).hexdigest()


def test_awkward_rows(spark, awkward, nothing):
    got = runs.with_runs(awkward.withColumnRenamed("label", "runs"))
    assert got.columns.count("runs") == 1 and got.count() == awkward.count()
    by_id = {r.doc_id: r for r in got.collect()}
    assert all(by_id[i].runs == [] and by_id[i].collapsed == "" for i in (3, 4, 5))
    assert runs.with_runs(nothing).collect() == []
    figures = {r.doc_id: r for r in runs.digest_columns(runs.with_runs(runs.with_planted_runs(awkward))).collect()}
    assert len(figures) == 12 and figures[3].n_runs == 0 and figures[3].start is None
    assert figures[None].n_runs == 0
