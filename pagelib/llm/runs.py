"""Periodic runs of words, found with suffix trees.

A run is a stretch of words of smallest period q that no neighbouring word extends. Each document is a sequence of word
numbers. Ukkonen's tree of the sequence and that of its reversal answer how far two places agree to the right and to the
left: the lowest common ancestor of two leaves is the shallowest node that the Euler tour meets between them, which a table
of minima over powers of two gives in constant time. Leaves in the order of the tour are the suffixes in order, so the next
smaller suffix ends the longest Lyndon word at each place; every run has such a word, under one of the two orders of the
alphabet, as its root. Each root is extended both ways, and stretches that hold it often enough are runs.

Before the trees are built, a document is cut where no run can pass: a run of exponent e holds each of its words e times,
so a word that stands less often in a stretch ends it. The cut is exact and repeated PEELINGS times; in plain prose little
is left. Memory is linear in the longest stretch left (times its logarithm for the table of minima).

A null or empty text has no words and no runs. Repeated rows are answered alike. Texts are read whole; columns named `runs`
and `collapsed` are replaced, others kept. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from pagelib.llm.common import WORD, query, table

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
PEELINGS = 3
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = "struct<runs: array<struct<start: long, length: long, period: long>>, collapsed: string>"


class SuffixTree:
    """Ukkonen's tree of a sequence of numbers from 1 up, closed by 0."""

    def __init__(self, numbers: list[int]) -> None:
        s = [*numbers, 0]
        self.width = width = max(s) + 1
        n = len(s)
        begin, end, link, child = [0], [0], [0], {}     # edge into each node, suffix links, node * width + symbol -> node
        leaves = []                                     # the leaf of each suffix, in order
        node = edge = length = waiting = 0
        for at, symbol in enumerate(s):
            waiting += 1
            last = 0
            while waiting:
                if not length:
                    edge = at
                key = node * width + s[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(begin)
                    leaves.append(len(begin))
                    begin.append(at)
                    end.append(n)
                    link.append(0)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    first = begin[below]
                    span = min(end[below], at + 1) - first
                    if length >= span:
                        edge += span
                        length -= span
                        node = below
                        continue
                    if s[first + length] == symbol:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    split = len(begin)
                    child[key] = split
                    leaves.append(split + 1)
                    begin += (first, at)
                    end += (first + length, n)
                    link += (0, 0)
                    child[split * width + symbol] = split + 1
                    begin[below] = first + length
                    child[split * width + s[first + length]] = below
                    if last:
                        link[last] = split
                    last = split
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = at - waiting + 1
        self.size = np.array(end, dtype=np.int64) - np.array(begin, dtype=np.int64)
        keys = np.fromiter(child, dtype=np.int64, count=len(child))
        self.parent, self.symbol = np.divmod(keys, width)
        self.node = np.fromiter(child.values(), dtype=np.int64, count=len(child))
        self.leaves = leaves

    def tour(self, backward: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in the order of the tour's leaves, and before each the length of the path to the shallowest node met
        since the last leaf. `backward` turns the alphabet round; the end stays smallest."""
        symbol = np.where(self.symbol > 0, self.width - self.symbol, 0) if backward else self.symbol
        order = np.lexsort((-symbol, self.parent))       # children in reverse: the stack hands them out in order
        nodes = self.node[order].tolist()
        at = np.searchsorted(self.parent[order], np.arange(len(self.size) + 1)).tolist()
        size, depth = self.size.tolist(), [0] * len(self.size)
        up = [0] * len(self.size)
        suffix = {leaf: i for i, leaf in enumerate(self.leaves)}
        far = len(self.leaves)
        found, shared, low = [], [], far
        stack = [0]
        while stack:
            node = stack.pop()
            if node:
                above = depth[up[node]]
                if above < low:
                    low = above
                depth[node] = above + size[node]
            if at[node] == at[node + 1]:
                found.append(suffix[node])
                shared.append(low)
                low = far
            else:
                below = nodes[at[node]:at[node + 1]]
                for child in below:
                    up[child] = node
                stack += below
        return np.array(found, dtype=np.int64), np.array(shared, dtype=np.int32)


class Extension:
    """How many words agree from two places on, for many pairs at once."""

    def __init__(self, order: np.ndarray, shared: np.ndarray) -> None:
        self.rank = np.empty(len(order), dtype=np.int64)
        self.rank[order] = np.arange(len(order))
        self.least = [shared]
        step = 1
        while 2 * step < len(shared):
            self.least.append(np.minimum(self.least[-1][:-step], self.least[-1][step:]))
            step *= 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For places that differ."""
        a, b = self.rank[a], self.rank[b]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(a), dtype=np.int64)
        for k in np.unique(level):
            w = np.flatnonzero(level == k)
            out[w] = np.minimum(self.least[k][low[w]], self.least[k][high[w] - (1 << int(k))])
        return out


def lyndon_ends(order: np.ndarray) -> np.ndarray:
    """End of the longest Lyndon word at each place: where the next smaller suffix begins."""
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    rank = rank.tolist()
    ends = list(range(1, len(rank) + 1))
    for i in range(len(rank) - 2, -1, -1):
        j = i + 1
        while rank[j] > rank[i]:
            j = ends[j]
        ends[i] = j
    return np.array(ends[:-1], dtype=np.int64)


def runs_of_stretch(numbers: np.ndarray, least_length: int, least_exponent: int) -> np.ndarray:
    """Rows (start, length, period) of the runs of a sequence of numbers from 0 up."""
    _, dense = np.unique(numbers, return_inverse=True)
    numbers, n = (dense + 1).tolist(), len(dense)
    tree = SuffixTree(numbers)
    forward = tree.tour()
    roots = np.concatenate([lyndon_ends(forward[0]), lyndon_ends(tree.tour(backward=True)[0])])
    place = np.tile(np.arange(n), 2)
    right = Extension(*forward)(place, roots)
    del tree, forward
    period = roots - place
    left = Extension(*SuffixTree(numbers[::-1]).tour())(n - place, n - roots)
    start, length = place - left, left + period + right
    keep = (length >= least_length) & (length >= least_exponent * period)
    return np.unique(np.stack([start[keep], length[keep], period[keep]], axis=1), axis=0)


def stretches(numbers: np.ndarray, least_length: int, least_exponent: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches that may hold runs."""
    alive = np.bincount(numbers)[numbers] >= least_exponent
    spans: list[tuple[int, int]] = []
    for turn in range(PEELINGS):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], alive.view(np.int8), [0]])))
        begin, end = edge[::2], edge[1::2]
        enough = end - begin >= least_length
        begin, end = begin[enough], end[enough]
        spans = list(zip(begin.tolist(), end.tolist()))
        if not spans or turn == PEELINGS - 1:
            break
        alive = np.zeros(len(numbers), dtype=bool)
        for a, b in spans:
            part = numbers[a:b]
            _, where, count = np.unique(part, return_inverse=True, return_counts=True)
            alive[a:b] = count[where] >= least_exponent
    return spans


def runs_of(words: list, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """Rows (start, length, period) of all runs of `words` with length >= least_length and >= least_exponent periods,
    sorted. The exponent is 2 at least."""
    if least_exponent < 2:
        raise ValueError("a run holds its period twice at least")
    none = np.empty((0, 3), dtype=np.int64)
    if len(words) < least_length:
        return none
    known: dict = {}
    numbers = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    found = [runs_of_stretch(numbers[a:b], least_length, least_exponent) + [a, 0, 0]
             for a, b in stretches(numbers, least_length, least_exponent)]
    return np.concatenate(found) if found else none


def without_runs(words: list[bytes], runs: np.ndarray) -> bytes:
    """Words joined by one blank, of each run only the first period."""
    if len(runs):
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
    return b" ".join(words)


def finder(least_length: int, least_exponent: int):
    @arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        runs, at, collapsed = [], [0], []
        for text in texts.cast(pa.binary()).to_pylist():
            words = text.split() if text else []      # cuts at exactly the white space of the word rule
            found = runs_of(words, least_length, least_exponent)
            runs.append(found)
            at.append(at[-1] + len(found))
            collapsed.append(without_runs(words, found))
        flat = np.concatenate(runs) if runs else np.empty((0, 3), dtype=np.int64)
        rows = pa.StructArray.from_arrays([pa.array(flat[:, i].copy()) for i in range(3)], fields=list(RUN))
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(pa.array(at, pa.int32()), rows), pa.array(collapsed, pa.binary()).cast(pa.string())], names=["runs", "collapsed"])

    return find


def with_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """`docs` (text, …) with `runs`, an array of (start, length, period) sorted by start, then period, and `collapsed`, the
    text's words with only the first period of every run."""
    found = docs.withColumn("__found", finder(least_length, least_exponent)(F.col("text")))
    return found.withColumns({"runs": F.col("__found.runs"), "collapsed": F.col("__found.collapsed")}).drop("__found")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text, …), where in one text of ten the words from some place on repeat those at that place.

    With h = crc32 of the id and g = h div 10, texts with h mod 10 = 0 change: from word a = g mod n on, the p words there
    repeat to the end, p = 1 + (n - a) div (3 + g mod 8). Rows without an id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    words = docs.withColumn("__words", F.when(chosen, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    sized = words.withColumns({"__n": F.size("__words"), "__g": F.floor(h / 10)})
    placed = sized.withColumn("__a", F.when(F.col("__n") > 0, F.col("__g") % F.col("__n")).cast("int"))
    left = F.col("__n") - F.col("__a")
    placed = placed.withColumn("__p", (1 + F.floor(left / (3 + F.col("__g") % 8))).cast("int"))
    block = F.slice("__words", F.col("__a") + 1, F.col("__p"))
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil(left / F.col("__p")).cast("int"))), F.lit(1), left)
    text = F.array_join(F.concat(F.slice("__words", F.lit(1), F.col("__a")), tail), " ")
    return (placed.withColumn("text", F.when(chosen & (F.col("__n") > 0), text).otherwise(F.col("text")))
            .drop("__words", "__n", "__g", "__a", "__p"))


def digest_columns(found: DataFrame) -> DataFrame:
    """doc_id and the figures of `with_runs`: number of runs, the longest (ties: first start, then period), and digests."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    best = found.withColumn("__best", longest)
    length, period = F.col("__best.length"), -F.col("__best.period")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("__best.start")).alias("start"), length.alias("length"),
        period.alias("period"), F.expr("1000 * __best.length div -__best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))


# Places of a word in a document meet each other where they are one possible period apart; neighbouring meetings of one
# distance are a stretch of that period, and the smallest period of a stretch counts. A word of a run stands there four times.
SQL_OP11 = r"""
WITH hashed AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)),
      lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) AS h
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
split AS (
  SELECT row_number() OVER () AS r, doc_id, h, h // 10 AS g,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents LEFT JOIN hashed USING (doc_id)),
sized AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 AND h % 10 = 0 THEN g % len(w) END AS a FROM split),
docs AS MATERIALIZED (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w
    ELSE list_concat(w[1:a], list_transform(range(a, n), lambda i: w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1])) END AS w FROM sized),
words AS MATERIALIZED (SELECT r, n, unnest(w) AS word, unnest(range(n)) AS i FROM docs),
often AS MATERIALIZED (SELECT * FROM words QUALIFY count(*) OVER (PARTITION BY r, word) >= 4),
meetings AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM often x JOIN often y ON x.r = y.r AND x.word = y.word AND x.i < y.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM meetings),
periodic AS (SELECT r, min(i) AS start, count(*) + q AS length, q FROM islands GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS MATERIALIZED (SELECT r, start, length, min(q) AS period FROM periodic GROUP BY r, start, length),
figures AS (
  SELECT r, count(*) AS n_runs, arg_max({'start': start, 'length': length, 'period': period}, (length, -start, -period)) AS best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY r),
dropped AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
  1000 * best.length // best.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM docs LEFT JOIN figures USING (r) LEFT JOIN kept USING (r)
"""


@query("op11_runs", SQL_OP11)
def op11_runs(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return digest_columns(with_runs(with_planted_runs(docs)))
