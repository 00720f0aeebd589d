"""Substring dedup over sliding sentence spans.

A text is cut into sentences: at line ends, after . ! ? before a blank, and after the stops of other scripts. A capital alone
ends no sentence. A sentence of more than 8 words counts as several: it is cut after each word whose hash is the smallest of
the seven around it, so that pieces of a passage are the same wherever in a sentence it stands, also where it was pasted
without a stop. In scripts without blanks between words each character counts as a word. Every run of three sentences is
hashed, and equal runs meet across the whole corpus. The first one, by (doc_id, text hash, place), stays. The sentences under
all other runs are covered. A stretch of covered sentences is removed, with the white space after it, if it holds 25 words
(a parameter): names, addresses, headings and rows of tables that texts share stay whole. A passage may be merged with the
text around it at both ends and loses at most the sentence or piece there, some words each, from its stretch.

A task sends each run once and settles its own repeats, so a passage that a third of all texts hold costs one row a
task. Rows with equal doc_id and text are one document: they stay or change together. Null texts stay null, empty ones
empty; a text may lose everything and is then empty. A null doc_id comes before all others. Other columns are kept. An
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pagelib.llm.common import query, table

RUN = 3              # consecutive sentences hashed together
LEAST_WORDS = 25     # a shorter stretch of covered sentences stays
PIECE_WORDS = 8      # a longer sentence counts as several
NEAR = 3             # words on each side that a cut in a long sentence depends on
STRIDE = 12          # of cuts where words repeat so closely that none is the smallest: a multiple of every period up to NEAR + 1
BUFFER_RUNS = 500_000
NULL_ID = -(1 << 63)

# A break begins at white space, so that a search skips to it.
BREAK = r"\s(?:(?<=[.!?…؟۔।॥։]\s)\s*|(?<=\n)\s*|\s*\n\s*)"
STOPS = "。！？｡．။៕"                       # need no blank after them
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WIDE_BREAK = re.compile(rf"{BREAK}|(?<=[{STOPS}])[」』）”’]*\s*(?![{STOPS}」』）”’])")
BREAK = re.compile(BREAK)
WORDS, WIDE_WORDS = re.compile(r"\S+"), re.compile(rf"[{UNSPACED}]|[^\s{UNSPACED}]+")
WIDE = re.compile(f"[{STOPS}{UNSPACED}]")
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
RUNS = "run long, doc long, text_hash long, at int, repeat boolean"


def cuts(long: list[list[str]]) -> list[list[int]]:
    """Where the pieces of each long sentence begin; each follows from the words near it."""
    line = (" " * (NEAR + 1)).join(map(" ".join, long)).encode("utf-8", "surrogatepass").split(b" ")
    n = len(line)
    h = np.full(n + 2 * NEAR, 1 << 32, dtype=np.int64)
    h[NEAR:n + NEAR] = np.fromiter(map(crc32, line), dtype=np.int64, count=n)
    at = np.cumsum([len(words) + NEAR for words in long])     # ends of the gaps between sentences
    for k in range(NEAR):
        h[at + k] = 1 << 32
    own = h[NEAR:n + NEAR]
    least = np.ones(n, dtype=bool)
    for k in range(1, NEAR + 1):
        least &= (own < h[NEAR - k:n + NEAR - k]) & (own <= h[NEAR + k:n + NEAR + k])
    found, out, at, i = np.flatnonzero(least).tolist(), [], 0, 0
    for words in long:
        begins, end = [0], len(words)
        while i < len(found) and found[i] < at + end:
            k = found[i] - at
            if NEAR <= k < end - 1:
                begins.append(k + 1)
            i += 1
        if end > 4 * STRIDE:
            begins = [x for a, b in zip(begins, [*begins[1:], end]) for x in (range(a, b, STRIDE) if b - a > 4 * STRIDE else (a,))]
        out.append(begins)
        at += end + NEAR
    return out


def sentences(text: str, placed: bool = True) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of each sentence; `end` includes the white space after it. Unless `placed`, only the words count."""
    whole, start = [], 0
    wide = not text.isascii() and WIDE.search(text) is not None
    breaks, one = (WIDE_BREAK, WIDE_WORDS) if wide else (BREAK, WORDS)
    ends = [m.span() for m in breaks.finditer(text)]
    ends.append((len(text), len(text)))
    for stop, after in ends:
        words = one.findall(text, start, after) if wide else text[start:stop].split()
        if words:
            whole.append((start, after, words))
        elif whole:
            whole[-1] = (whole[-1][0], after, whole[-1][2])
        else:
            continue
        start = after
    long = [w for _, _, w in whole if len(w) > PIECE_WORDS]
    if not long:
        return whole
    out, begins_of = [], iter(cuts(long))
    for part in whole:
        start, after, words = part
        if len(words) <= PIECE_WORDS:
            out.append(part)
            continue
        begins = next(begins_of)
        places = [m.start() for m in one.finditer(text, start, after)] if placed else None
        for i, j in zip(begins, [*begins[1:], len(words)]):
            out.append((places[i] if i else start, after if j == len(words) else places[j], words[i:j]) if placed else (0, 0, words[i:j]))
    return out


def run_hashes(parts: list[tuple[int, int, list[str]]]) -> np.ndarray:
    """Signed hash of every RUN consecutive sentences."""
    n = len(parts) - RUN + 1
    if n < 1:
        return np.empty(0, dtype=np.int64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(" ".join(w).encode()) for _, _, w in parts), dtype=np.uint64, count=len(parts))
    mixed = h[:n] * FACTORS[0]
    for k in range(1, RUN):
        mixed += h[k:n + k] * FACTORS[k]
    mixed ^= mixed >> np.uint64(31)
    return (mixed * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def runs_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each run of a task once, at its first place (repeat false), and the task's other places (repeat true)."""
    held: list[list[np.ndarray]] = []
    size = 0

    def flush():
        run, doc, text_hash, at = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((at, text_hash, doc, run))
        run, doc, text_hash, at = run[order], doc[order], text_hash[order], at[order]
        same = np.zeros(len(run), dtype=bool)
        same[1:] = run[1:] == run[:-1]
        # Repeated rows of one document are no repeats of each other.
        copy = same.copy()
        copy[1:] &= (doc[1:] == doc[:-1]) & (text_hash[1:] == text_hash[:-1]) & (at[1:] == at[:-1])
        start = np.maximum.accumulate(np.where(same, 0, np.arange(len(run))))
        first = (doc == doc[start]) & (text_hash == text_hash[start]) & (at == at[start])
        keep = ~copy
        for i in range(0, len(run), 100_000):
            k = np.flatnonzero(keep[i:i + 100_000]) + i
            yield pa.RecordBatch.from_arrays([pa.array(x[k]) for x in (run, doc, text_hash, at, ~first)],
                                             names=["run", "doc", "text_hash", "at", "repeat"])

    for batch in batches:
        for doc, text_hash, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            h = run_hashes(sentences(text, placed=False)) if text else ()
            if len(h):
                held.append([h, np.full(len(h), doc), np.full(len(h), text_hash), np.arange(len(h), dtype=np.int32)])
                size += len(h)
        if size > BUFFER_RUNS:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def later_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that are not the first of their run; they come sorted by (run, doc, text_hash, at)."""
    last = None      # first row of the run that reaches into the next batch
    for batch in batches:
        run, doc, text_hash, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        if not len(run):
            continue
        new = np.ones(len(run), dtype=bool)
        new[1:] = run[1:] != run[:-1]
        if last is not None and last[0] == run[0]:
            new[0] = False
        start = np.maximum.accumulate(np.where(new, np.arange(len(run)), -1))
        head = [np.where(start >= 0, c[start], 0 if last is None else last[i + 1]) for i, c in enumerate((doc, text_hash, at))]
        later = ~((doc == head[0]) & (text_hash == head[1]) & (at == head[2]))
        k = start[-1]
        if k >= 0:
            last = (run[k], doc[k], text_hash[k], at[k])
        yield pa.RecordBatch.from_arrays([pa.array(x[later]) for x in (doc, text_hash, at)], names=["doc", "text_hash", "at"])


CLEANED = StructType([StructField("text", StringType()), StructField("n_sentences", LongType()),
                      StructField("n_removed", LongType()), StructField("words_removed", LongType())])


def remove_runs(text: str, places, least_words: int = LEAST_WORDS) -> tuple[str, int, int, int]:
    """The text without the stretches of sentences that runs cover; `places` are the runs' first sentences."""
    if not len(places):
        return text, len(sentences(text, placed=False)), 0, 0
    parts = sentences(text)
    covered = np.zeros(len(parts) + 1, dtype=bool)
    for p in places:
        covered[p:p + RUN] = True
    # A stretch of covered sentences goes as a whole, or stays where it is too short for a passage.
    edges = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0))
    for a, b in zip(edges[::2], edges[1::2]):
        if sum(len(words) for _, _, words in parts[a:b]) < least_words:
            covered[a:b] = False
    removed = int(covered.sum())
    words = sum(len(w) for (_, _, w), c in zip(parts, covered) if c)
    kept = "".join(text[a:b] for (a, b, _), c in zip(parts, covered) if not c) if removed else text
    return kept, len(parts), removed, words


def cleaner(least_words: int):
    @pandas_udf(CLEANED)
    def clean(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, places in batches:
            rows = [(None, 0, 0, 0) if t is None else remove_runs(t, p if p is not None else (), least_words) for t, p in zip(texts, places)]
            text, n, removed, words = zip(*rows) if rows else ((), (), (), ())
            yield pd.DataFrame({"text": pd.Series(text, dtype=object), "n_sentences": pd.Series(n, dtype="int64"),
                                "n_removed": pd.Series(removed, dtype="int64"), "words_removed": pd.Series(words, dtype="int64")})

    return clean


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """`docs` (doc_id, text, …) with the texts cleaned, and n_sentences, n_removed and words_removed; these names are replaced."""
    keyed = docs.withColumns({"__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "__hash": F.xxhash64("text")})
    runs = keyed.select("__doc", "__hash", "text").mapInArrow(runs_of_texts, RUNS)
    # Both kinds of rows come from one pass: repeats are dealt by their document and text, the others by their run.
    dealt = runs.repartition(F.when(F.col("repeat"), F.xxhash64("doc", "text_hash")).otherwise(F.col("run")))
    later = (dealt.sortWithinPartitions("repeat", "run", "doc", "text_hash", "at")
             .mapInArrow(later_or_repeat, "doc long, text_hash long, at int"))
    places = (later.groupBy(F.col("doc").alias("__doc"), F.col("text_hash").alias("__hash"))
              .agg(F.array_sort(F.collect_set("at")).alias("__places")))
    joined = keyed.join(places, ["__doc", "__hash"], "left")
    own = ["text", "n_sentences", "n_removed", "words_removed"]
    return (joined.withColumn("__clean", cleaner(least_words)(F.col("text"), F.col("__places")))
            .withColumns({c: F.col(f"__clean.{c}") for c in own})
            .select(*dict.fromkeys([*docs.columns, *own])))


def later_or_repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First the rows to settle, sorted by run, then the tasks' own repeats, which pass through."""
    def unsettled(rest: list):
        for batch in batches:
            repeat = batch.column("repeat").to_numpy(zero_copy_only=False)
            n = int((~repeat).sum())
            if n:
                yield batch.slice(0, n)
            if n < len(repeat):
                rest.append(batch.slice(n))
                return

    rest: list[pa.RecordBatch] = []
    yield from later_places(unsettled(rest))
    for batch in chain(rest, batches):
        yield batch.select(["doc", "text_hash", "at"])


@query("op5_substrings")
def op5_substrings(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_sentences", "n_removed", "words_removed", "text")
