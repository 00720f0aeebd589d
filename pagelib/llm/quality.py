"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's features are its words, the shapes of its words ("Xx", "X!", "|"), and how far it repeats itself; each kind is
hashed into a fixed range. Counts are damped, weighted by inverse document frequency over the whole corpus, and projected
on the leading singular vectors of a bounded labelled sample. The sample's vectors and labels are broadcast (their bound
is TRAIN_ROWS * DIMS numbers). Every text is compared with all of them by exact cosine, in blocks, and its nearest
neighbours vote with weights that grow with their similarity.

Null and empty texts have a zero vector and get the sample's mean label. Texts are read whole. Rows that repeat score
alike; other columns are kept. Without labelled rows every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from pagelib.llm.common import distinct_passages, held_out, labelled_sample, query, table

TRAIN_ROWS = 8192    # bound of the labelled sample
DIMS = 48            # of the latent space
NEIGHBOURS = 15
SHARPNESS = 12       # a neighbour votes with similarity to this power
CUT = 0.3
BLOCK = 256          # texts compared at a time
CACHE_WORDS = 120_000

WORDS, SHAPES, HABITS = 1024, 512, 64
WIDTH = WORDS + SHAPES + HABITS
WEIGHTS = np.repeat([0.35, 1.0, 1.0], [WORDS, SHAPES, HABITS])

UPPER, LOWER, DIGIT = re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"[a-zß-öø-ÿ]+"), re.compile(r"\d+")
RUN = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    return RUN.sub(r"\1", DIGIT.sub("9", LOWER.sub("x", UPPER.sub("X", word))))


class WordIds(dict):
    """word -> word feature * SHAPES + shape feature, kept once computed."""

    def __missing__(self, word: str) -> int:
        core = word.strip(".,;:!?\"'()|").lower()
        v = self[word] = crc32(core.encode()) % WORDS * SHAPES + crc32(shape(word).encode()) % SHAPES
        return v


class Counter:
    def __init__(self) -> None:
        self.ids = WordIds()

    def of(self, text: str | None) -> np.ndarray:
        """Feature counts of a text."""
        out = np.zeros(WIDTH, dtype=np.float32)
        words = text.split() if text else []
        if not words:
            return out
        if len(self.ids) > CACHE_WORDS:
            self.ids.clear()
        both = np.fromiter(map(self.ids.__getitem__, words), dtype=np.int64, count=len(words))
        out[:WORDS] = np.bincount(both // SHAPES, minlength=WORDS)
        out[WORDS:WORDS + SHAPES] = np.bincount(both % SHAPES, minlength=SHAPES)
        # Habits: share of words that repeat the word before them, and how many distinct words stand in a run of 64.
        n = len(both)
        again = int(15.999 * (both[1:] == both[:-1]).mean()) if n > 1 else 0
        pairs = np.unique(both[:-1] * 1_000_003 + both[1:]).size / (n - 1) if n > 1 else 1.0
        out[WORDS + SHAPES + again] = 4
        out[WORDS + SHAPES + 16 + int(15.999 * pairs)] = 4
        return out


def damped(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length: (1 + log count) * idf * weight of the kind; a text's length does not count."""
    share = counts / np.maximum(counts[:, WORDS:WORDS + SHAPES].sum(1, keepdims=True), 1)
    v = np.log1p(200 * share) * idf * WEIGHTS
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return (v / np.maximum(norm, 1e-12)).astype(np.float32)


def document_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many texts of a task hold each feature; feature -1 counts the texts."""
    counter, held, n = Counter(), np.zeros(WIDTH, dtype=np.int64), 0
    for batch in batches:
        for text in batch["text"]:
            held += counter.of(text) > 0
            n += 1
    yield pd.DataFrame({"feature": np.arange(-1, WIDTH), "n": np.concatenate([[n], held])})


def inverse_frequency(docs: DataFrame) -> np.ndarray:
    rows = (docs.select("text").mapInPandas(document_counts, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
            .toPandas().set_index("feature")["n"])
    n = rows.reindex(range(-1, WIDTH), fill_value=0).to_numpy(dtype=float)
    return np.log((n[0] + 1) / (n[1:] + 1)) + 0.1


def sparse_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counter = Counter()
    for batch in batches:
        found = [counter.of(t) for t in batch["text"]]
        at = [np.flatnonzero(c) for c in found]
        yield pd.DataFrame({"at": at, "n": [c[i] for c, i in zip(found, at)], "label": batch["label"].to_numpy()})


class Model:
    def __init__(self, idf: np.ndarray, counts: np.ndarray, labels: np.ndarray):
        self.idf, self.labels = idf, labels.astype(np.float32)
        self.mean = float(labels.mean()) if len(labels) else 0.5
        rows = damped(counts, idf)
        _, vectors = np.linalg.eigh((rows.T @ rows).astype(np.float64))
        self.basis = np.ascontiguousarray(vectors[:, ::-1][:, :DIMS], dtype=np.float32)
        self.known = self.latent(rows)

    def latent(self, rows: np.ndarray) -> np.ndarray:
        v = rows @ self.basis
        return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)

    def votes(self, counts: np.ndarray) -> np.ndarray:
        """Score of each row of feature counts."""
        near = self.latent(damped(counts, self.idf)) @ self.known.T
        k = min(NEIGHBOURS, near.shape[1])
        if not k:
            return np.full(len(counts), self.mean)
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** SHARPNESS
        prior = 0.02
        return ((weight * self.labels[top]).sum(1) + prior * self.mean) / (weight.sum(1) + prior)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Document frequencies of all of `docs`; neighbours from labelled rows that are not held out."""
    idf = inverse_frequency(docs)
    sample = (distinct_passages(labelled_sample(docs, labels, "quality", train_rows))
              .mapInPandas(sparse_counts, "at array<int>, n array<float>, label int").toPandas())
    counts = np.zeros((len(sample), WIDTH), dtype=np.float32)
    for i, (at, n) in enumerate(zip(sample["at"], sample["n"])):
        counts[i, at] = n
    return Model(idf, counts, sample["label"].to_numpy(dtype=float))


def scorer(docs: DataFrame, model: Model):
    """A column function: text -> score in 0..1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter()
        for texts in batches:
            out = np.zeros(len(texts))
            for s in range(0, len(texts), BLOCK):
                part = texts.iloc[s:s + BLOCK]
                out[s:s + BLOCK] = shared.value.votes(np.stack([counter.of(t) for t in part]))
            yield pd.Series(out)

    return score


def with_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """`docs` with a `quality_score` column; it replaces one of that name."""
    return docs.withColumn("quality_score", scorer(docs, fit(docs, labels, train_rows))(F.col("text")))


@query("op7_quality")
def op7_quality(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = with_quality(docs, table(spark, folder, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"),
                         (F.col("quality_score") >= CUT).cast("int").alias("predicted"))
