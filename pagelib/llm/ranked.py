"""Ranked lexical search by range maxima over posting lists.

`index_documents` deals documents into shards of a few thousand; a shard is a row with its documents in the order of their
lengths and the posting lists of all its terms. Nothing is shuffled, and the index serves any queries.

A search takes the posting lists of the query's terms in a shard, computes each posting's exact impact, and builds a table
of maxima over powers of two for every list. An interval of documents is bounded by the sum over terms of the largest impact
in it, two look-ups a term. The interval with the largest bound comes first: it is split at the document that holds the
largest single impact, this document is scored exactly, and the two rests get bounds of their own. The search of a shard
ends when no bound reaches the k-th score (equal scores: the smaller id). Intervals are taken a batch at a time, so that
numpy does the look-ups; a batch starts at one interval and doubles.

The k-th scores rise from shard to shard in a task, and one shard in SEEDS is searched first, so that all others start from
the k-th scores of these. Both only save work: a k-th score of some documents is never above that of all.

Queries are the stated set of items, in blocks of ITEMS by a hash of the id: the driver holds the terms of one block. Rows of
equal item_id are one item with the terms of all. Every row of the documents is a document, equal rows too; a null doc_id
ranks behind all others. Texts without a term, null or empty, are no documents and find nothing. Other columns are ignored.
An empty table on either side gives an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from pagelib.llm.common import query, small, table
from pagelib.session import materialise

SHARD_DOCS = 4096
SHARD_WORDS = 1_500_000
ITEMS = 1024
SEEDS = 8
BATCH = 256             # most intervals split at a time
NO_ID = np.iinfo(np.int64).max
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The same rule on UTF-8: bytes from 0x80 on belong to characters that belong to terms.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A or 0x30 <= b <= 0x39 else 0x20 for b in range(256))
INDEX = ("n_docs long, n_words long, doc_id array<long>, terms array<string>, counts array<int>, "
         "lengths binary, posting_doc binary, posting_count binary")
HITS = "item_id long, doc_id long, score long"


class Shard:
    """Documents gathered for one row of the index."""

    def __init__(self) -> None:
        self.known: defaultdict[bytes, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.ids: list[int | None] = []
        self.texts: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        self.ids.append(doc_id)
        self.texts.append(np.fromiter(map(self.known.__getitem__, words), dtype=np.int32, count=len(words)))
        self.size += len(words)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.size >= SHARD_WORDS

    def row(self) -> pa.RecordBatch:
        n, terms = len(self.ids), len(self.known)
        lengths = np.array([len(t) for t in self.texts], dtype=np.int64)
        names = np.array([NO_ID if i is None else i for i in self.ids], dtype=np.int64)
        order = np.lexsort((names, lengths))
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        pairs = np.concatenate(self.texts) * np.int64(n) + np.repeat(place, lengths)
        pairs.sort()
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        term, doc = np.divmod(pairs[first], n)
        count = np.diff(first, append=len(pairs))
        return pa.RecordBatch.from_arrays(
            [pa.array([n]), pa.array([self.size]), pa.array([[self.ids[i] for i in order]], pa.list_(pa.int64())),
             pa.array([[w.decode() for w in self.known]], pa.list_(pa.string())),
             pa.array([np.bincount(term, minlength=terms).astype(np.int32)], pa.list_(pa.int32())),
             pa.array([lengths[order].astype(np.int32).tobytes()]), pa.array([doc.astype(np.int32).tobytes()]),
             pa.array([count.astype(np.int32).tobytes()])],
            names=[c.split()[0] for c in INDEX.split(", ")])


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard = Shard()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            words = text.translate(FOLD).split() if text else []
            if words:
                shard.add(doc_id, words)
                if shard.full():
                    yield shard.row()
                    shard = Shard()
    if shard.ids:
        yield shard.row()


def index_documents(docs: DataFrame) -> DataFrame:
    """The index of `docs` (doc_id, text), written to the shared folder."""
    given = docs.select(F.col("doc_id").cast("long"), "text")
    return materialise(given.mapInArrow(shards, INDEX), "lexical-index")


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def maxima(values: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Row j holds the largest of values[i : i + 2**j] at i, and its place, as far as `longest` needs. A last column, which
    no interval reaches, stands for places behind the end."""
    values = np.append(values, 0)
    rows, step = [np.arange(len(values), dtype=np.int32)], 1
    while 2 * step <= longest:
        above = rows[-1].copy()
        other = rows[-1][step:]
        above[:-step] = np.where(values[above[:-step]] >= values[other], above[:-step], other)
        rows.append(above)
        step *= 2
    places = np.stack(rows)
    return values[places], places


class SearchShard:
    """One row of the index with the posting lists of a block's terms."""

    def __init__(self, row: dict, terms: pa.Array, weights: np.ndarray, documents: int, words: int) -> None:
        """`row`: the columns of the index with binary columns as arrays."""
        lengths = row["lengths"]
        self.n = len(lengths)
        self.ids = row["ids"]
        each, back = np.unique(lengths, return_inverse=True)
        norm = np.array([100 - 50 + (50 * int(x) * documents) // words for x in each], dtype=np.int64)[back]
        found = pc.index_in(terms, value_set=row["terms"]).to_numpy(zero_copy_only=False)
        here = np.flatnonzero(~np.isnan(found)) if found.dtype.kind == "f" else np.arange(len(found))
        counts = row["counts"].astype(np.int64)
        at = np.cumsum(counts) - counts
        which = found[here].astype(np.int64)
        size = counts[which]
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.list_of = np.full(len(terms), -1, dtype=np.int64)
        self.list_of[here] = np.arange(len(here))
        total = int(self.end[-1]) if len(here) else 0
        source = np.repeat(at[which] - self.start, size) + np.arange(total)
        self.doc = row["posting_doc"][source]
        count = row["posting_count"][source].astype(np.int64)
        self.impact = np.repeat(weights[here], size) * ((1_000_000_000 * count) // (1000 * count + 20 * norm[self.doc]))
        longest = int(size.max()) if len(here) else 0
        self.table, self.place = maxima(self.impact, longest)
        self.first_id = -maxima(-self.ids, self.n)[0]
        self.log = np.frexp(np.arange(max(longest, self.n) + 1).astype(np.float64))[1] - 1
        self.log[0] = 0
        self.log = self.log.astype(np.int32)
        self.scored = 0       # documents scored so far

    def best(self, terms: np.ndarray, k: int, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best k of (scores, ids), sorted, and of this shard's documents with a score above 0."""
        lists = self.list_of[terms]
        lists = lists[lists >= 0]
        if not len(lists):
            return scores, ids
        start, size = self.start[lists], self.end[lists] - self.start[lists]
        # before[d, t]: where in the list of t the documents from d on begin.
        column = np.repeat(np.arange(len(lists)), size)
        postings = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        before = np.zeros((self.n + 1, len(lists)), dtype=np.int32)
        before[self.doc[postings] + 1, column] = 1
        before[0] = start
        np.cumsum(before, axis=0, out=before)

        width = self.table.shape[1]
        flat, places, impact = self.table.ravel(), self.place.ravel(), np.append(self.impact, 0)

        def bound(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Sum of the lists' maxima in each interval, and the document of the largest."""
            left, right = before[low], before[high]
            span = right - left
            level = self.log[span]
            row = level.astype(np.int64) * width
            a, b = row + left, row + np.maximum(right - (1 << level), 0)
            top = np.maximum(flat[a], flat[b])
            top[span == 0] = 0
            widest = top.argmax(axis=1)
            every = np.arange(len(widest))
            a, b = a[every, widest], b[every, widest]
            return top.sum(axis=1), self.doc[np.minimum(np.where(flat[a] >= flat[b], places[a], places[b]), len(self.doc) - 1)]

        def reaches(bounds: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            """Intervals that may hold one of the best k."""
            if len(scores) < k:
                return bounds > 0
            may = bounds > scores[-1]
            tied = np.flatnonzero(bounds == scores[-1])
            if len(tied):
                level = self.log[high[tied] - low[tied]]
                first = np.minimum(self.first_id[level, low[tied]], self.first_id[level, high[tied] - (1 << level)])
                may[tied] = first < ids[-1]
            return may

        low, high = np.array([0]), np.array([self.n])
        bounds, split = bound(low, high)
        batch = 1
        while True:
            open_ = reaches(bounds, low, high)
            low, high, bounds, split = low[open_], high[open_], bounds[open_], split[open_]
            if not len(low):
                return scores, ids
            if len(low) > batch:
                order = np.argpartition(-bounds, batch - 1)
                now, rest = order[:batch], order[batch:]
            else:
                now, rest = np.arange(len(low)), np.arange(0)
            a, b, doc = low[now], high[now], split[now].astype(np.int64)
            here, after = before[doc], before[doc + 1]
            score = np.where(after > here, impact[here], 0).sum(axis=1)
            every, names = np.concatenate([scores, score]), np.concatenate([ids, self.ids[doc]])
            order = np.lexsort((names, -every))[:k]
            scores, ids = every[order], names[order]
            child_low, child_high = np.concatenate([a, doc + 1]), np.concatenate([doc, b])
            some = child_high > child_low
            child_low, child_high = child_low[some], child_high[some]
            child_bounds, child_split = bound(child_low, child_high)
            low, high = np.concatenate([low[rest], child_low]), np.concatenate([high[rest], child_high])
            bounds, split = np.concatenate([bounds[rest], child_bounds]), np.concatenate([split[rest], child_split])
            self.scored += len(now)
            batch = min(2 * batch, BATCH)


def searcher(items: list[tuple[int | None, np.ndarray]], terms: list[str], weights: np.ndarray, k: int, documents: int, words: int,
             least: dict[int | None, tuple[int, int]]):
    """A task's best k of every item; documents behind the item's `least` (score, id) are left out."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(terms, pa.string())
        best = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)) for _ in items]
        floor = [least.get(item) for item, _ in items]
        for i, f in enumerate(floor):
            if f is not None:     # stands for k documents as good as it
                best[i] = (np.full(k, f[0]), np.full(k, f[1]))
        for batch in batches:
            for r in range(len(batch)):
                part = {c: batch.column(c)[r] for c in batch.schema.names}
                ids = pc.fill_null(part["doc_id"].values, NO_ID).to_numpy(zero_copy_only=False)
                row = {"ids": ids, "terms": part["terms"].values, "counts": part["counts"].values.to_numpy(zero_copy_only=False)}
                row |= {c: np.frombuffer(part[c].as_buffer(), dtype=np.int32) for c in ("lengths", "posting_doc", "posting_count")}
                shard = SearchShard(row, wanted, weights, documents, words)
                for i, (_, own) in enumerate(items):
                    best[i] = shard.best(own, k, *best[i])
        for (item, _), (scores, ids), f in zip(items, best, floor):
            real = np.ones(len(ids), dtype=bool) if f is None else (scores > f[0]) | (ids < f[1])
            names = pa.array(ids[real], mask=ids[real] == NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array([item] * int(real.sum()), pa.int64()), names, pa.array(scores[real])],
                                             names=["item_id", "doc_id", "score"])

    return search


def best_of(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def terms_of(text: str):
    """Column expression: the distinct terms of a text."""
    return F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0)))


def search_block(index: DataFrame, block: DataFrame, k: int, documents: int, words: int) -> DataFrame:
    """(item_id, rank, doc_id, score) for `block` (item_id, term), distinct rows of a bounded number of items."""
    block = materialise(block, "lexical-block")
    asked = small(block.select("term").distinct(), 1 << 20)
    frequency = (index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), "x.counts")
                 .join(asked, "term").groupBy("term").agg(F.sum("counts").alias("df")))
    rows = block.join(frequency, "term").collect()      # one block of the stated queries
    terms = sorted({r["term"] for r in rows})
    number = {t: i for i, t in enumerate(terms)}
    known = {r["term"]: r["df"] for r in rows}
    weights = np.array([weight(documents, known[t]) for t in terms], dtype=np.int64)
    own: dict[int | None, list[int]] = {}
    for r in rows:
        own.setdefault(r["item_id"], []).append(number[r["term"]])
    items = [(i, np.array(sorted(t))) for i, t in sorted(own.items(), key=lambda x: (x[0] is None, x[0]))]
    seed = F.pmod(F.xxhash64("doc_id"), F.lit(SEEDS)) == 0

    def search(shards_: DataFrame, least: dict) -> DataFrame:
        return best_of(shards_.mapInArrow(searcher(items, terms, weights, k, documents, words, least), HITS), k)

    first = materialise(search(index.where(seed), {}), "lexical-seeds")
    least = {r["item_id"]: (r["score"], NO_ID if r["doc_id"] is None else r["doc_id"]) for r in first.where(F.col("rank") == k).collect()}
    rest = search(index.where(~seed), least)
    return best_of(first.drop("rank").unionByName(rest.drop("rank")), k).select("item_id", "rank", "doc_id", "score")


def search(index: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score) of the `k` best documents of every row of `items` (item_id, text)."""
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms_of("text")).alias("term")).distinct()
    documents, words = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    blocks = max(1, -(-items.select("item_id").distinct().count() // ITEMS))
    block_of = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found = [search_block(index, asked.where(block_of == b), k, documents, words) for b in range(blocks)]
    if blocks > 1:
        found = [materialise(f, "lexical-hits") for f in found]
    return reduce(DataFrame.unionByName, found)


SQL_OP13 = rf"""
WITH words AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}'), lambda x: x <> '') AS w FROM documents),
docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, w, len(w)::HUGEINT AS n FROM words WHERE len(w) > 0),
size AS (SELECT count(*)::HUGEINT AS docs, sum(n) AS total FROM docs),
items AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
asked AS (SELECT DISTINCT term FROM items),
tf AS MATERIALIZED (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) JOIN asked USING (term) GROUP BY r, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs)::DOUBLE + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, size GROUP BY term),
impact AS (
  SELECT r, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * size.docs) // size.total))) AS s
  FROM tf JOIN weights USING (term) JOIN docs USING (r), size),
scores AS (SELECT item_id, r, sum(s) AS score FROM items JOIN impact USING (term) GROUP BY item_id, r HAVING sum(s) > 0)
SELECT item_id, (row_number() OVER best)::INTEGER AS rank, doc_id, score::BIGINT AS score
FROM scores JOIN docs USING (r)
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
QUALIFY row_number() OVER best <= 50
"""


@query("op13_ranked", SQL_OP13)
def op13_ranked(spark, folder):
    return search(index_documents(table(spark, folder, "documents")), table(spark, folder, "benchmark"))
