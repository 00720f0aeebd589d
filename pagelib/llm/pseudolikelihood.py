"""Document scores by masked pseudo-likelihood.

A small network reads two words on each side of a place and predicts the word that stands there; a text's score sums the
log probabilities of all its words, each given its neighbours. The network reads the most frequent words of the whole
corpus, and hash buckets for the rest. It predicts a word's class (words in frequency order, cut into classes of equal
mass, so that frequent words are classes of their own), not the word; within a class a word has its share of the corpus
counts, whatever its neighbours. A word in a bucket has its own share of the bucket too: the counts of all words stay
distributed, and each text's rare words meet them in a join. Vocabulary, buckets and classes grow with the corpus.

Each text is cut into words twice: to count them, and to write down its places and rare words as numbers. Training, scoring
and the join read these numbers.

Training is data-parallel: every task runs one pass of Adagrad over all windows of its texts from the same start, the
tasks' networks are summed on the executors, weighted by their words, and the mean is the start of the next round. So
what is gathered (word counts and networks) grows with the corpus, and no text is left out. A recomputed task repeats
its result, as nothing depends on chance but a fixed seed.

Null, empty and blank texts have no words, log likelihood 0 and score 0. Texts are read whole. Rows that repeat score
alike; other columns are kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat
from math import isqrt
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from pagelib.llm.common import query, table
from pagelib.session import materialise

WORDS = 4096         # words with a place of their own, at least; else the square root of the corpus's words
SIDE = 2             # words read on each side
DIMS, HIDDEN = 8, 24
BATCH = 2048         # windows of one step
LARGEST = 40.0       # sums of exp of numbers up to here, and what is multiplied by them, stay far from the ends of float32
RATE = 0.1
ROUNDS = 1
FLUSH_WORDS = 150_000
CACHE_WORDS = 120_000
OFFSETS = [o for o in range(-SIDE, SIDE + 1) if o]


def sizes(words: int) -> tuple[int, int, int]:
    """Hash buckets, places (the one after them is outside the text) and classes for so many words of their own."""
    return words // 8, words + words // 8, isqrt(words)


def shapes(words: int) -> dict[str, tuple[int, ...]]:
    _, places, classes = sizes(words)
    return {"E": (places + 1, DIMS), "W1": (len(OFFSETS) * DIMS, HIDDEN), "b1": (HIDDEN,), "W2": (HIDDEN, classes), "b2": (classes,)}


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of a task; sent on whenever many different words have been met."""
    def batch_of(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                          names=["word", "n"])

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            counts.update(words_of(text))
            if len(counts) > FLUSH_WORDS:
                yield batch_of(counts)
                counts.clear()
    yield batch_of(counts)


class Vocabulary(dict):
    """word -> place; other words fall into hash buckets. `n` holds the corpus count of each place."""

    def __init__(self, words: list[str], counts: list[int], buckets: dict[int, int], size: int = WORDS):
        super().__init__({w: i for i, w in enumerate(words)})
        self.size = size
        self.buckets, self.places, classes = sizes(size)
        self.n = np.zeros(self.places)
        self.n[: len(counts)] = counts
        for b, n in buckets.items():
            self.n[size + b] = n
        order = np.lexsort((np.arange(self.places), -self.n))
        mass = np.cumsum(self.n[order]) - self.n[order] / 2
        self.group = np.zeros(self.places, dtype=np.int64)
        self.group[order] = np.minimum(classes - 1, (classes * mass / max(self.n.sum(), 1)).astype(int))
        smooth = self.n + 0.1
        self.within = np.log(smooth / np.bincount(self.group, weights=smooth, minlength=classes)[self.group])

    def __missing__(self, word: str) -> int:
        return self.size + crc32(word.encode()) % self.buckets

    def __reduce__(self):
        return Vocabulary, (list(self), self.n[: len(self)].tolist(), dict(enumerate(self.n[self.size:].tolist())), self.size)

    def places_of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of every word of the corpus."""
    return materialise(docs.select("text").mapInArrow(count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")),
                       "lm-counts")


def vocabulary(docs: DataFrame, counts: DataFrame | None = None) -> Vocabulary:
    """Places, counts and classes; words of their own and buckets reach the driver, about the square root of the corpus."""
    counts = corpus_counts(docs) if counts is None else counts
    size = max(WORDS, isqrt(counts.agg(F.sum("n")).first()[0] or 0))
    top = counts.orderBy(F.col("n").desc(), "word").limit(size).collect()
    least = (top[-1]["n"], top[-1]["word"]) if top else (0, "")
    rest = counts.where((F.col("n") < least[0]) | ((F.col("n") == least[0]) & (F.col("word") > least[1])))
    buckets = rest.groupBy((F.crc32("word") % sizes(size)[0]).alias("b")).agg(F.sum("n").alias("n")).collect()
    return Vocabulary([r["word"] for r in top], [r["n"] for r in top], {int(r["b"]): r["n"] for r in buckets}, size)


class Codes(dict):
    """word -> its place or, without a place of its own, a number after these; `place` and `hash` (as Spark's xxhash64) by number."""

    def __init__(self, words: Vocabulary):
        super().__init__()
        self.words = words
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.update(self.words)
        self.place, self.hash = np.arange(self.words.size), np.zeros(self.words.size, dtype=np.uint64)

    def codes_of(self, words: list[str]) -> np.ndarray:
        """Numbers of `words`; they hold until the next call."""
        if len(self.place) > self.words.size + CACHE_WORDS:
            self.forget()
        new = [w for w in dict.fromkeys(words) if w not in self]
        self.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        raw = [w.encode() for w in new]
        crc = np.fromiter(map(crc32, raw), dtype=np.int64, count=len(raw))
        self.place = np.concatenate([self.place, self.words.size + crc % self.words.buckets])
        self.hash = np.concatenate([self.hash, np.fromiter(map(xxhash.xxh64_intdigest, raw, repeat(42)), dtype=np.uint64, count=len(raw))])
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


def code_lines(codes: Codes, lines: list[list[str]], fresh: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places of all words; by text the number of rare words; hashes and counts of the rare words of `fresh` texts, and how many by text."""
    length = np.array([len(p) for p in lines], dtype=np.int64)
    code = codes.codes_of(list(chain.from_iterable(lines)))
    at = np.flatnonzero(code >= codes.words.size)
    owner = np.repeat(np.arange(len(lines)), length)[at]
    n_rare = np.bincount(owner, minlength=len(lines))
    new = fresh[owner]
    found, times = np.unique(owner[new] << 40 | code[at][new], return_counts=True)
    return (codes.place[code].astype(np.int32), n_rare, codes.hash[found & (1 << 40) - 1].view(np.int64), times,
            np.bincount(found >> 40, minlength=len(lines)))


CODED = "n_tokens long, n_rare long, places binary, rare array<struct<word: long, n: long>>"


def coder(docs: DataFrame, words: Vocabulary):
    """Number of words, number of those in buckets, places (int32) and rare words of a text; of equal texts of a task, one has rare words."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    @arrow_udf(CODED)
    def code(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        codes, seen = Codes(shared.value), set()
        for texts, keys in batches:
            parts, lines, fresh, lengths, size = [], [], [], [], 0
            for text, key in zip(texts.to_pylist(), keys.to_pylist()):
                p = words_of(text)
                lines.append(p)
                lengths.append(len(p))
                fresh.append(key not in seen)
                seen.add(key)
                size += len(p)
                if size >= 16 * BATCH:
                    parts.append(code_lines(codes, lines, np.array(fresh, dtype=bool)))
                    lines, fresh, size = [], [], 0
            parts.append(code_lines(codes, lines, np.array(fresh, dtype=bool)))
            place, n_rare, word, n, rare = (np.concatenate(x) for x in zip(*parts))
            ends = lambda x: pa.array(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])).cast(pa.int32())
            places = pa.Array.from_buffers(pa.binary(), len(texts), [None, ends(np.array(lengths) * 4).buffers()[1], pa.py_buffer(place)])
            own = pa.ListArray.from_arrays(ends(rare), pa.StructArray.from_arrays([pa.array(word), pa.array(n)], names=["word", "n"]))
            yield pa.StructArray.from_arrays([pa.array(np.array(lengths, dtype=np.int64)), pa.array(n_rare), places, own],
                                             names=["n_tokens", "n_rare", "places", "rare"])

    return lambda text: code(text, F.xxhash64(text))


def coded(docs: DataFrame, words: Vocabulary, keep: list[str]) -> DataFrame:
    """Columns `keep` of `docs`, the hash of the text as `__text` and what `coder` finds as `__lm`, stored."""
    return materialise(docs.select(*keep, F.xxhash64("text").alias("__text"), coder(docs, words)(F.col("text")).alias("__lm")), "lm-places")


def places_in(column: pa.Array) -> list[np.ndarray]:
    """Places of texts as `coder` stores them."""
    return [np.frombuffer(x.as_buffer(), dtype=np.int32) for x in column]


def rare_shares(texts: DataFrame, words: Vocabulary, counts: DataFrame) -> DataFrame:
    """(text_hash, share): mean log share of their buckets that a text's rare words have."""
    spark = texts.sparkSession
    totals = spark.createDataFrame([(b, float(n)) for b, n in enumerate(words.n[words.size:].tolist())], "b long, total double")
    bucket = lambda w: F.crc32(w) % words.buckets
    known = (counts.withColumn("b", bucket("word")).join(F.broadcast(totals), "b")
             .select(F.xxhash64("word").alias("word"), F.log(F.col("n") / F.greatest("total", F.col("n"))).alias("share")))
    found = texts.select(F.col("__text").alias("text_hash"), F.inline("__lm.rare"))
    joined = found.join(known.hint("shuffle_hash"), "word")
    # Equal texts come from several tasks: a mean is the same for one of them and for all.
    return joined.groupBy("text_hash").agg((F.sum(F.col("n") * F.col("share")) / F.sum("n")).alias("share"))


class Network:
    def __init__(self, flat: np.ndarray | None = None, size: int = WORDS, seed: int = 3):
        own = shapes(size)
        self.slot = np.zeros(own["E"][0], dtype=np.int64)
        if flat is None:
            rng = np.random.default_rng(seed)
            self.p = {k: (rng.standard_normal(s) * (0.1 if k == "E" else s[0] ** -0.5) if len(s) == 2 else np.zeros(s)).astype(np.float32)
                      for k, s in own.items()}
        else:
            ends = np.cumsum([int(np.prod(s)) for s in own.values()])[:-1]
            self.p = {k: x.reshape(s).astype(np.float32) for (k, s), x in zip(own.items(), np.split(flat, ends))}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.p])

    def weights(self, k: str) -> np.ndarray:
        """Weights of layer k with their constants as the last row."""
        return np.concatenate([self.p["W" + k], self.p["b" + k][None]])

    def forward(self, context: np.ndarray):
        """Input, hidden layer and log probabilities of all classes for windows of `context` (rows, words read)."""
        x, h, z = self.logits(context, self.weights("1"), self.weights("2"))
        return x, h[:, :HIDDEN], z - np.log(np.exp(z).sum(1, keepdims=True))

    def logits(self, context: np.ndarray, first: np.ndarray, second: np.ndarray):
        """Input, hidden layer with a last column of 1, and numbers whose exp is in proportion to the classes' probabilities."""
        x = np.take(self.p["E"], context.ravel(), axis=0).reshape(len(context), -1)
        h = np.ones((len(context), HIDDEN + 1), dtype=np.float32)
        a = x @ first[:-1]
        a += first[-1]
        np.tanh(a, out=h[:, :HIDDEN])
        z = h @ second
        # As |h| <= 1, no number in `z` is beyond the sum of its class's weights.
        if not np.abs(second).sum(0).max() <= LARGEST:
            z -= z.max(1, keepdims=True)
        return x, h, z

    def log_probabilities(self, context: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Log probabilities of the classes `group` for windows of `context`."""
        first, second, logs = self.weights("1"), self.weights("2"), np.empty(len(group))
        for s in range(0, len(group), BATCH):
            part = slice(s, s + BATCH)
            z = self.logits(context[part], first, second)[2]
            logs[part] = z[np.arange(len(z)), group[part]]
            logs[part] -= np.log(np.exp(z, out=z) @ np.ones(z.shape[1], dtype=np.float32))
        return logs

    def step(self, context: np.ndarray, group: np.ndarray, memory: dict[str, np.ndarray]) -> None:
        """One step of Adagrad on the mean log loss."""
        p, rows = self.p, len(context)
        x, h, d = self.logits(context, self.weights("1"), self.weights("2"))
        whole = np.exp(d, out=d) @ np.ones(d.shape[1], dtype=np.float32)
        # The gradient of the logits is `d` divided by `whole` and `rows`; the narrow factors beside it are divided instead.
        d[np.arange(rows), group] -= whole
        share = (1 / (whole * rows))[:, None]
        own = h[:, :HIDDEN]
        dh = (d @ p["W2"].T) * share
        dh *= 1 - own * own
        h *= share
        sums = h.T @ d
        dx = (dh @ p["W1"].T).reshape(-1, DIMS)
        at = context.ravel()
        # Rows of E that no window reads have no gradient and stay.
        read = np.zeros(len(self.slot), dtype=bool)
        read[at] = True
        rows = np.flatnonzero(read)
        self.slot[rows] = np.arange(len(rows))
        at = self.slot[at]
        g = np.stack([np.bincount(at, weights=column, minlength=len(rows)) for column in np.ascontiguousarray(dx.T)], 1).astype(np.float32)
        held = memory["E"].take(rows, 0) + g * g
        memory["E"][rows] = held
        p["E"][rows] -= RATE * g / (np.sqrt(held) + 1e-6)
        # The last row of `sums` belongs to the hidden layer's column of 1.
        for k, g in {"W2": sums[:-1], "b2": sums[-1], "W1": x.T @ dh, "b1": dh.sum(0)}.items():
            memory[k] += g * g
            p[k] -= RATE * g / (np.sqrt(memory[k]) + 1e-6)


def windows(places: list[np.ndarray], outside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, words, text number) of all places of several texts."""
    gap = np.full(SIDE, outside)
    line = np.concatenate([gap, *[x for p in places for x in (p, gap)]])
    at = np.flatnonzero(line != outside)
    owner = np.repeat(np.arange(len(places)), [len(p) for p in places])
    return np.stack([line[at + o] for o in OFFSETS], 1), line[at], owner


def train_task(words, start):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, net = words.value, Network(start.value, words.value.size)
        memory = {k: np.full(s, 1e-4, dtype=np.float32) for k, s in shapes(known.size).items()}
        seen, held, size = 0, [], 0

        def learn():
            context, word, _ = windows(held, known.places)
            group = known.group[word]
            for s in range(0, len(word), BATCH):
                net.step(context[s:s + BATCH], group[s:s + BATCH], memory)

        for batch in batches:
            for p in places_in(batch.column("places")):
                if len(p):
                    held.append(p)
                    size += len(p)
                    if size >= 16 * BATCH:
                        learn()
                        seen, held, size = seen + size, [], 0
        if held:
            learn()
            seen += size
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([(net.flat().astype(np.float64) * seen).astype(np.float32).tobytes()], pa.binary())],
                                             names=["weight", "sum"])

    return train


def add_networks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weight, total = 0.0, None
    for batch in batches:
        for w, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            v = np.frombuffer(s, dtype=np.float32).astype(np.float64)
            weight, total = weight + w, v if total is None else total + v
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["weight", "sum"])


def train(docs: DataFrame, words: Vocabulary, rounds: int = ROUNDS) -> Network:
    """A network trained on the texts of `docs`."""
    return train_coded(coded(docs, words, []), words, rounds)


def train_coded(texts: DataFrame, words: Vocabulary, rounds: int = ROUNDS) -> Network:
    """The mean of the tasks' networks, `rounds` times; sums run on the executors until at most 16 rows are left."""
    context = texts.sparkSession.sparkContext
    shared, flat = context.broadcast(words), Network(size=words.size).flat()
    for _ in range(rounds):
        sums = materialise(texts.select("__lm.places").mapInArrow(train_task(shared, context.broadcast(flat)), "weight double, sum binary"), "lm-networks")
        n = sums.count()
        while n > 16:
            n = -(-n // 32)
            sums = materialise(sums.repartition(n).mapInArrow(add_networks, "weight double, sum binary"), "lm-networks")
        rows = sums.collect()
        if rows:
            flat = sum(np.frombuffer(r["sum"], dtype=np.float32).astype(np.float64) for r in rows) / sum(r["weight"] for r in rows)
    return Network(flat.astype(np.float32), words.size)


def scorer(docs: DataFrame, words: Vocabulary, net: Network):
    """Scores in which a bucket stands for all its words, and the number of a text's words in buckets."""
    code, judge = coder(docs, words), place_scorer(docs, words, net)

    def score(text):
        lm = code(F.col(text) if isinstance(text, str) else text)
        total, n = judge(lm["places"]), lm["n_tokens"]
        return F.struct(n.alias("n_tokens"), total.alias("log_likelihood"), mean_probability(total, n).alias("score"), lm["n_rare"].alias("n_rare"))

    return score


def mean_probability(total, n):
    return F.when(n > 0, F.exp(total / n)).otherwise(0.0)


def place_scorer(docs: DataFrame, words: Vocabulary, net: Network):
    """Log likelihood of a text's places, in which a bucket stands for all its words."""
    context = docs.sparkSession.sparkContext
    shared, flat = context.broadcast(words), context.broadcast(net.flat())

    @arrow_udf("double")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, own = shared.value, Network(flat.value, shared.value.size)
        for column in batches:
            total, held, at, size = np.zeros(len(column)), [], [], 0

            def settle():
                contexts, word, owner = windows(held, known.places)
                logs = own.log_probabilities(contexts, known.group[word]) + known.within[word]
                total[at] = np.bincount(owner, weights=logs, minlength=len(at))

            for i, p in enumerate(places_in(column)):
                if len(p):
                    held.append(p)
                    at.append(i)
                    size += len(p)
                    if size >= 16 * BATCH:
                        settle()
                        held, at, size = [], [], 0
            if held:
                settle()
            yield pa.array(total)

    return judge


def with_likelihood(docs: DataFrame, rounds: int = ROUNDS, keep: list[str] | None = None) -> DataFrame:
    """`docs`, or its columns `keep`, with n_tokens, log_likelihood and score (mean probability of a word); these names are replaced."""
    keep = docs.columns if keep is None else keep
    counts = corpus_counts(docs)
    words = vocabulary(docs, counts)
    texts = coded(docs, words, keep)
    net = train_coded(texts, words, rounds)
    shares = rare_shares(texts, words, counts).withColumnsRenamed({"text_hash": "__text", "share": "__share"})
    n, rare = F.col("__lm.n_tokens"), F.col("__lm.n_rare")
    scored = texts.select(*keep, "__text", n.alias("__n"), rare.alias("__rare"), place_scorer(docs, words, net)(F.col("__lm.places")).alias("__own"))
    total = F.col("__own") + F.when(F.col("__rare") > 0, F.col("__rare") * F.col("__share")).otherwise(0.0)
    return (scored.join(shares, "__text", "left").withColumn("__total", total)
            .withColumns({"n_tokens": F.col("__n"), "log_likelihood": F.col("__total"), "score": mean_probability(F.col("__total"), F.col("__n"))})
            .select(*dict.fromkeys([*keep, "n_tokens", "log_likelihood", "score"])))


@query("op3_pseudolikelihood")
def op3_pseudolikelihood(spark, folder):
    return with_likelihood(table(spark, folder, "documents").select("doc_id", "text"), keep=["doc_id"])
