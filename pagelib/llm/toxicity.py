"""Toxicity by noisy-channel deobfuscation.

Words that carry signs of disguise (digits or symbols among letters, runs of one letter, letters set apart) are
restored: a Viterbi search runs over the lattice of what each run of equal characters may stand for, under a character
trigram model of the whole corpus. The restored words are then scored. A feature (a restored word, or its first five to
seven letters) is kept where toxic texts hold it more often than chance explains, however many features are tried; it
weighs its share of toxic texts among the training rows that hold it. A text's score is the chance that at least one of
its features is right.

Null and empty texts score 0. Texts are read whole, however long. Rows that repeat score alike; other columns are
kept as they are. Without labelled rows every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from pagelib.llm.common import distinct_passages, held_out, labelled_sample, query, table
from pagelib.session import materialise

TRAIN_ROWS = 30_000      # bound of the labelled sample that the features are learned from
LEAST_ROWS = 5           # training rows that hold a feature
LEAST_SHARE = 0.75       # of toxic rows among them
CHANCE = 0.01            # that any feature of a clean vocabulary is kept
EVERY = ""               # counts all rows
CUT = 0.5
PREFIXES = (5, 6, 7)     # letters of the beginnings that count beside a whole word
CACHE_WORDS = 100_000   # a worker forgets its word cache beyond this

# What a character often stands for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
        "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¢": "c"}
SUBSTITUTED, SEPARATED, SHORTENED, KEPT = -1.5, -0.7, -0.3, -2.0   # channel log probabilities

EDGES = re.compile(r"^[^\w@$€£¢]+|[^\w@$€£¢]+$")
DISGUISED = re.compile(r"[^\W\d_].*[\d@$€£¢!|+.\-_*~'`,:;/\\]|[\d@$€£¢!|+].*[^\W\d_]|([^\W\d_])\1\1")
SPACED = re.compile(r"(?<!\S)(?:\S[ \t]){3,}\S(?!\S)")


# The same classes for UTF-8 bytes: white space is a word edge, and of a longer character the first byte counts.
CLASSES = bytes(0 if b in b" \t\n\r\x0b\x0c" else b - 96 if 97 <= b <= 122 else 27 for b in range(256))
CONTINUED = bytes(range(0x80, 0xC0))


def letter(c: str) -> int:
    """Character class of the model: 0 word edge, 1-26 a letter, 27 anything else."""
    return ord(c) - 96 if "a" <= c <= "z" else 27


def trigram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Character trigrams of all words of a task's texts, as (gram, n) with gram in 0 .. 28^3 - 1; a word starts with two edges."""
    total = np.zeros(28 ** 3, dtype=np.int64)
    for batch in batches:
        line = " ".join(t for t in batch["text"] if t).lower().encode("utf-8", "surrogatepass")
        ids = np.frombuffer(b"\0\0" + line.translate(CLASSES, CONTINUED) + b"\0", dtype=np.uint8).astype(np.int32)
        a, b, c = ids[:-2], ids[1:-1], ids[2:]
        inside = (b != 0) | (c != 0)
        total += np.bincount((((a * (b != 0)) * 28 + b) * 28 + c)[inside], minlength=28 ** 3)
    at = np.flatnonzero(total)
    yield pd.DataFrame({"gram": at, "n": total[at]})


def character_model(docs: DataFrame) -> np.ndarray:
    """log p(c | a, b) as an array [a, b, c], interpolated with the shorter contexts. At most 28^3 rows are collected."""
    rows = (docs.select("text").mapInPandas(trigram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
            .toPandas())
    n = np.zeros(28 ** 3)
    n[rows["gram"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=float)
    n = n.reshape(28, 28, 28)
    one = (n.sum((0, 1)) + 1) / (n.sum() + 28)
    pair = n.sum(0)
    two = (pair + 20 * one) / (pair.sum(1, keepdims=True) + 20)
    return np.log((n + 20 * two[None]) / (n.sum(2, keepdims=True) + 20)).astype(np.float64)


def runs_of(word: str) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    for c in word:
        if out and out[-1][0] == c:
            out[-1] = (c, out[-1][1] + 1)
        else:
            out.append((c, 1))
    return out


def readings(c: str, n: int) -> list[tuple[str, float]]:
    """What a run of n equal characters may stand for, with the channel's log probability."""
    if c.isalpha():
        if n == 1:
            return [(c, 0.0)]
        return [(c * 2, 0.0), (c, SUBSTITUTED)] if n == 2 else [(c * 2, SHORTENED), (c, SHORTENED)]
    out = [(a * min(n, k), SUBSTITUTED) for a in LEET.get(c, "") for k in ((1,) if n == 1 else (1, 2))]
    out.append((c if n == 1 else c * n, KEPT))
    if not c.isdigit():
        out.append(("", SEPARATED))
    return out


def restore(word: str, model: np.ndarray) -> str:
    """The likeliest reading of a disguised word: Viterbi over the lattice, state = last two character classes."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for c, n in runs_of(word):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        options = readings(c, n)
        for (a, b), (score, path) in best.items():
            for text, cost in options:
                s, x, y = score + cost, a, b
                for z in map(letter, text):
                    s += model[x, y, z]
                    x, y = y, z
                old = after.get((x, y))
                if old is None or s > old[0]:
                    after[(x, y)] = (s, (path, text))
        best = after
    path = max(((s + model[a, b, 0], p) for (a, b), (s, p) in best.items()), key=lambda t: t[0])[1]
    parts = []
    while path:
        path, text = path
        parts.append(text)
    return "".join(reversed(parts))


def features_of(word: str, model: np.ndarray) -> tuple[str, ...]:
    word = EDGES.sub("", word)
    if DISGUISED.search(word):
        word = restore(word, model)
    if len(word) < 3:
        return ()
    return (word, *[word[:n] + "*" for n in PREFIXES if len(word) > n])


def words_of(text: str) -> set[str]:
    """Distinct words of a text; letters set apart by single blanks join into one more word."""
    text = text.lower()
    words = set(text.split())
    words.update(re.sub(r"\s", "", m) for m in SPACED.findall(text))
    return words


def feature_counts(model: np.ndarray):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, tuple[str, ...]] = {}
        seen: dict[str, list[int]] = {}

        def flush():
            frame = pd.DataFrame({"feature": pd.Series(list(seen), dtype=object), "toxic": [v[1] for v in seen.values()],
                                  "clean": [v[0] for v in seen.values()]})
            seen.clear()
            return frame

        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                found: set[str] = {EVERY}
                for w in words_of(text):
                    f = cache.get(w)
                    if f is None:
                        if len(cache) > CACHE_WORDS:
                            cache.clear()
                        f = cache[w] = features_of(w, model)
                    found.update(f)
                for f in found:
                    seen.setdefault(f, [0, 0])[1 if label else 0] += 1
                if len(seen) > CACHE_WORDS:
                    yield flush()
        yield flush()

    return count


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS,
        most_features: int | None = None) -> tuple[np.ndarray, dict[str, float]]:
    """The character model of all `docs` and the features learned from labelled rows that are not held out.

    All features that chance does not explain are kept, or the surest `most_features`; the sample of labelled rows bounds
    their number.
    """
    model = character_model(docs)
    sample = distinct_passages(labelled_sample(docs, labels, "toxic", train_rows))
    counts = materialise(sample.mapInPandas(feature_counts(model), "feature string, toxic long, clean long").groupBy("feature")
                         .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxic-features")
    n = F.col("toxic") + F.col("clean")
    total = counts.where(F.col("feature") == EVERY).select("toxic", n.alias("n")).first()
    if total is None or not 0 < total["toxic"] < total["n"]:
        return model, {}
    base, tried = total["toxic"] / total["n"], counts.where(n >= LEAST_ROWS).count()
    share = F.col("toxic") / n
    gain = share * F.log(share / base) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0)
    rows = (counts.where((F.col("feature") != EVERY) & (n >= LEAST_ROWS) & (share >= LEAST_SHARE))
            .where(F.log(F.lit(tried)) - n * gain < math.log(CHANCE))
            .select("feature", ((F.col("toxic") + 0.5) / (n + 1.5)).alias("share"), n.alias("n"))
            .orderBy(F.col("share").desc(), F.col("n").desc(), "feature"))
    rows = (rows if most_features is None else rows.limit(most_features)).collect()
    return model, {r["feature"]: math.log1p(-r["share"]) for r in rows}


def scorer(model: np.ndarray, features: dict[str, float]):
    """A column function: text -> score in 0..1."""

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[str, tuple[str, ...]] = {}
        for texts in batches:
            out = np.zeros(len(texts))
            for i, text in enumerate(texts):
                if not text:
                    continue
                hits: set[str] = set()
                for w in words_of(text):
                    f = cache.get(w)
                    if f is None:
                        if len(cache) > 3 * CACHE_WORDS:     # most words share one empty tuple
                            cache.clear()
                        f = cache[w] = tuple(x for x in features_of(w, model) if x in features)
                    if f:
                        hits.update(f)
                out[i] = 0.0 - math.expm1(sum(features[f] for f in sorted(hits)))
            yield pd.Series(out)

    return score


def with_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """`docs` with a `toxicity` column; it replaces one of that name."""
    return docs.withColumn("toxicity", scorer(*fit(docs, labels, train_rows))(F.col("text")))


@query("op10_toxicity")
def op10_toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    scored = with_toxicity(docs.select("doc_id", "text"), table(spark, folder, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"),
                         (F.col("toxicity") >= CUT).cast("int").alias("predicted"))
