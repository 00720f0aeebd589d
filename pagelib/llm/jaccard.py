"""N-gram Jaccard join over prefix trees.

Texts with equal shingle sets are one class. Two classes with 9 * shared >= 4 * (sizes together), a Jaccard of 0.8,
share one of the first n - ceil(0.8 n) + 1 shingles of either set in any fixed order; rare shingles first (counted in
a sketch of the whole corpus) keeps common passages out of these prefixes. Candidates meet on prefix shingles by one
shuffle, and the sets themselves are compared in tries: sets in hash order share the nodes of their common beginnings,
a probe adds up its overlap along a path once for all sets below, and leaves a subtree whose remaining lengths cannot
reach the bound.

Components take two rounds, so that no group is expanded into pairs. First each class is tried against its centre, the
class it meets most often among the leading ones of their shared shingles. Then every class is tried against each *other
component* it meets, in tiles of that component's members, until one link is found. Every link between different
components is found, and links inside one need not be. Exact: no sampling, no cap.

Rows are the documents: a repeated doc_id is joined by its text alone. Null, empty or blank texts have no shingle and
link with nothing; a null doc_id is never the smallest. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pagelib.llm.common import components, query, small, table
from pagelib.llm.shingles import Shingler, set_class, texts_of
from pagelib.session import materialise

SKETCH_BITS = 18         # cells of the shingle counts that order the sets; more cells order more finely
TILE = 256               # sets of one trie
PROBES = 1024            # probes that share one copy of a trie
SMALL_ROWS = 2_000_000   # (doc_id, class) rows that may be broadcast; more are joined by shuffle
NO_ID = (1 << 63) - 1
SETS = "doc_id long, text_hash long, n long, class long, sketch binary"
PREFIXES = "token long, class long, n int, pos int"
SHARED = "token long, class long, n int, pos int, centre long, centre_n int, fits boolean"


def required(n, m):
    """Shingles that sets of n and m must share."""
    return -(-4 * (n + m) // 9)


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, n, class) of each text, and one row with the task's shingle counts."""
    shingler, sketch = Shingler(), np.zeros(1 << SKETCH_BITS, dtype=np.int32)
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("class", pa.int64()),
                        ("sketch", pa.binary())])
    some = False
    for batch in batches:
        sizes, classes = [], []
        for text in texts_of(batch.column("text")):
            s = shingler.of(text)
            some = some or len(s) > 0
            np.add.at(sketch, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            sizes.append(len(s))
            classes.append(set_class(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()),
                                          pa.array(classes, pa.int64()), pa.nulls(len(sizes), pa.binary())], schema=schema)
    if some:
        none = pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([sketch.tobytes()], pa.binary())], schema=schema)


def add_sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    for batch in batches:
        for b in batch["sketch"]:
            total += np.frombuffer(b, dtype=np.int32)
    if total.any():
        yield pd.DataFrame({"sketch": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]})


def corpus_counts(sketches: DataFrame) -> np.ndarray:
    """The sum of all tasks' sketches, added up on the executors until at most 16 are left."""
    n = sketches.count()
    while n > 16:
        n = -(-n // 32)
        sketches = materialise(sketches.repartition(n).mapInPandas(add_sketches, "sketch binary"), "sketches")
    total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    for row in sketches.collect():
        total += np.frombuffer(row["sketch"], dtype=np.int32)
    return np.minimum(total, 2**31 - 1).astype(np.int32)


def prefix_rows(counts):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen, order = Shingler(), set(), counts.value
        for batch in batches:
            tokens, classes, sizes, places = [], [], [], []
            for text in texts_of(batch.column("text")):
                s = shingler.of(text)
                if not len(s) or (c := set_class(s)) in seen:
                    continue
                seen.add(c)
                p = len(s) - -(-4 * len(s) // 5) + 1
                rank = order[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                tokens.append(s[np.lexsort((s, rank))[:p]].view(np.int64))
                classes.append(np.full(p, c))
                sizes.append(np.full(p, len(s), dtype=np.int32))
                places.append(np.arange(p, dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, classes, sizes, places)],
                                                 names=["token", "class", "n", "pos"])

    return emit


def shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of shingles that several classes hold, with the leading class of each; rows come sorted by (token, pos, class).

    A class leads where fewest rarer shingles stand before: in a family of edited copies, the copy with the fewest edits.
    Only a run's first row is kept in memory, so a shingle may have any number of rows.
    """
    first, told = None, False    # first row of the run that reaches into the next batch; whether it has been passed on
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if first is not None:
            cols = [np.concatenate(([f], c)).astype(c.dtype) for f, c in zip(first, cols)]
        token, cls, n, pos = cols
        if not len(token):
            continue
        new = np.ones(len(token), dtype=bool)
        new[1:] = token[1:] != token[:-1]
        fresh = new.copy()
        fresh[1:] |= cls[1:] != cls[:-1]            # equal texts of several tasks
        start = np.maximum.accumulate(np.where(new, np.arange(len(token)), 0))
        several = np.zeros(len(token), dtype=bool)
        several[start[fresh & ~new]] = True
        keep = fresh & several[start]
        last = start[-1]
        carried, told_next = [c[last] for c in cols], bool(several[last]) or (told and last == 0)
        if first is not None and told:
            keep[0] = False
            keep |= fresh & (start == 0) & ~new     # the run was known to be shared before this batch
        first, told = carried, told_next
        at = np.flatnonzero(keep)
        if len(at):
            c = start[at]
            best = np.minimum(n[at] - pos[at], n[c] - pos[c])
            fits = (cls[at] != cls[c]) & (best >= required(n[at].astype(np.int64), n[c].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token[at], cls[at], n[at], pos[at], cls[c], n[c], fits)],
                                             names=["token", "class", "n", "pos", "centre", "centre_n", "fits"])


class Node:
    """A run of shingles that all sets below share; `least`, `most`: sizes of the sets below.

    `group` is the group of all sets below, or None if there are several.
    """

    __slots__ = ("run", "children", "ends", "least", "most", "group")

    def __init__(self, run: np.ndarray, size: int, group: int | None):
        self.run, self.children, self.ends, self.least, self.most, self.group = run, {}, [], size, size, group


def add_to_trie(root: Node, shingles: np.ndarray, name: int, group: int) -> None:
    node, rest, size = root, shingles, len(shingles)
    while True:
        node.least, node.most = min(node.least, size), max(node.most, size)
        if node.group != group:
            node.group = None
        if not len(rest):
            node.ends.append(name)
            return
        child = node.children.get(int(rest[0]))
        if child is None:
            child = node.children[int(rest[0])] = Node(rest, size, group)
            child.ends.append(name)
            return
        both = min(len(child.run), len(rest))
        differ = np.flatnonzero(child.run[:both] != rest[:both])
        same = int(differ[0]) if len(differ) else both
        if same < len(child.run):      # the run parts here
            upper = Node(child.run[:same], child.least, child.group)
            upper.most = child.most
            child.run = child.run[same:]
            upper.children[int(child.run[0])] = child
            node.children[int(upper.run[0])] = upper
            child = upper
        node, rest = child, rest[same:]


def search_trie(root: Node, probe: np.ndarray, group: int, groups: dict[int, int]) -> list[int]:
    """Names of the sets in the trie that link with `probe`, at most one of each group and none of the probe's own.

    `groups` has the group (component) of each name.
    """
    found: list[int] = []
    done = {group}
    n = len(probe)
    stack = [(root, 0, 0, 0)]      # node, shingles shared above it, place in the probe, shingles above it
    while stack:
        node, shared, at, depth = stack.pop()
        if node.group in done:
            continue
        if len(node.run):
            where = np.searchsorted(probe[at:], node.run)
            inside = where < n - at
            shared += int((probe[at:][where[inside]] == node.run[inside]).sum())
            at += int(np.searchsorted(probe[at:], node.run[-1], side="right"))
            depth += len(node.run)
        if shared + min(n - at, node.most - depth) < required(n, node.least):
            continue
        if node.ends and shared >= required(n, depth):
            for name in node.ends:
                if groups[name] not in done:
                    done.add(groups[name])
                    found.append(name)
        for child in node.children.values():
            stack.append((child, shared, at, depth))
    return found


def trie_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of probes and the sets of their key; rows come sorted by (k1, k2, k3, probe), a key's sets first.

    One key's trie is in memory; probes stream past it.
    """
    key, root, groups = None, None, {}
    for batch in batches:
        a, b = [], []
        for *now, probe, c, group, s in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if now != key:
                key, groups, root = now, {}, Node(np.empty(0, dtype=np.uint64), 1 << 60, None)
                root.most = 0
            shingles = np.frombuffer(s, dtype=np.uint64)
            if not probe:
                groups[c] = group
                add_to_trie(root, shingles, c, group)
            else:
                found = search_trie(root, shingles, group, groups)
                a += [c] * len(found)
                b += found
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def compare(targets: DataFrame, probes: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) of probes and targets that share a key (k1, k2, k3), one for each component a probe links with.

    Without a column `component` every class is its own.
    """
    key = ["k1", "k2", "k3"]
    side = lambda df, probe: df.select(
        *key, F.lit(probe).alias("probe"), "class", F.col("component" if "component" in df.columns else "class").alias("group"))
    rows = materialise(side(targets, False).union(side(probes, True)), "jaccard-rows")
    # The sets, from one text of each class that takes part.
    wanted = materialise(rows.select("class").distinct().join(classes, "class"), "jaccard-wanted")
    sets = (texts.join(small(wanted, SMALL_ROWS), F.col("doc_id").eqNullSafe(F.col("first"))).select("class", "text")
            .mapInArrow(shingle_bytes, "class long, shingles binary"))
    return materialise(rows.join(sets, "class").select(*key, "probe", "class", "group", "shingles").repartition(*key)
                       .sortWithinPartitions(*key, "probe").mapInArrow(trie_links, "a long, b long"), "jaccard-links")


def shingle_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler, seen = Shingler(), set()
    for batch in batches:
        names, sets = [], []
        for c, text in zip(batch.column("class").to_pylist(), texts_of(batch.column("text"))):
            s = shingler.of(text)
            # Rows may repeat, and another row may hold the same doc_id with another text.
            if len(s) and c not in seen and set_class(s) == c:
                seen.add(c)
                names.append(c)
                sets.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], names=["class", "shingles"])


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs` (doc_id, text)."""
    rows, by_class = classes_of(docs)
    return (rows.join(by_class, "class", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each component: the smallest doc_id's, at equal ids the text of the smallest hash.

    A null doc_id counts as the largest. Equal rows (doc_id and text) leave one. Rows without shingles all stay.
    """
    rows, by_class = classes_of(docs.select("doc_id", "text"))
    own_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = rows.where("class is not null").select("class", own_id.alias("__id"), F.col("text_hash").alias("__hash"))
    rows = materialise(rows.join(by_class, "class").groupBy("component", "__id", "__hash").agg(F.count("*").alias("copies")),
                       "jaccard-rows")
    best = rows.groupBy("component").agg(F.min(F.struct("__id", "__hash")).alias("best"))
    rows = rows.join(best, "component")
    stays = F.struct("__id", "__hash") == F.col("best")
    keyed = docs.withColumns({"__id": own_id, "__hash": F.xxhash64("text")})
    left = keyed.join(small(rows.where(~stays).select("__id", "__hash"), SMALL_ROWS), ["__id", "__hash"], "left_anti")
    several = small(rows.where(stays & (F.col("copies") > 1)).select("__id", "__hash"), SMALL_ROWS)
    single = left.join(several, ["__id", "__hash"], "left_anti").select(*docs.columns)
    picked = (left.join(several, ["__id", "__hash"], "left_semi").groupBy("__id", "__hash")
              .agg(F.first(F.struct(*docs.columns)).alias("x")).select("x.*"))
    return single.union(picked)


def classes_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n, class) for each row of `docs`, and (class, component, component_id) for each class."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    described = materialise(texts.mapInArrow(describe, SETS), "jaccard-sets")
    counts = spark.sparkContext.broadcast(corpus_counts(described.where("sketch is not null").select("sketch")))
    rows = described.where("sketch is null").drop("sketch")
    classes = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("first"))

    prefixes = texts.mapInArrow(prefix_rows(counts), PREFIXES)
    shared = materialise(prefixes.repartition("token").sortWithinPartitions("token", "pos", "class")
                         .mapInArrow(shared_rows, SHARED), "jaccard-shared")

    # Round 1: each class against its centre, the one it meets most often, if what they share may suffice. A class counts
    # as met only where it leads a shingle's run, so half of what the bound asks for is enough here.
    stars = (shared.where("class <> centre").groupBy("class", "n", "centre", "centre_n")
             .agg(F.count("*").alias("met"), F.max("fits").alias("fits"))
             .where(F.col("fits") & (2 * F.col("met") >= least_met(F.col("n"), F.col("centre_n"))))
             .groupBy("class").agg(F.max_by("centre", F.struct("met", "centre")).alias("centre")))
    stars = materialise(stars, "jaccard-stars")
    fans = stars.groupBy("centre").agg(F.count("*").alias("fans"))
    targets = stars.join(fans, "centre").select(F.col("centre").alias("k1"), tile_of("class", "fans").alias("k2"),
                                                F.lit(0).cast("long").alias("k3"), "class")
    probes = targets.select("k1", "k2", "k3", F.col("k1").alias("class")).distinct()
    links = compare(targets, probes, texts, classes)

    # Round 2: each class against the other components it meets; the smaller component asks.
    found = components(links, "jaccard-first")
    member = (shared.groupBy("class").agg(F.first("n").alias("n")).join(found, F.col("class") == F.col("node"), "left")
              .select("class", "n", F.coalesce("component", "class").alias("component")))
    size = member.groupBy("component").agg(F.count("*").alias("members"), F.min("n").alias("low"), F.max("n").alias("high"))
    member = materialise(member.join(size, "component"), "jaccard-members")
    met = shared.select("token", "class", "pos").join(member.select("class", "n", "component", "members"), "class").repartition("token")
    groups = (met.groupBy("token", F.col("component").alias("k1"))
              .agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("pos")).alias("rest"),
                   F.first("members").alias("k1_members"))
              .withColumn("others", F.count("*").over(Window.partitionBy("token"))).where("others > 1").drop("others"))
    # One shared shingle must leave enough behind it, in sizes that can link at all.
    fits = ((F.least(F.col("n") - F.col("pos"), F.col("rest")) >= F.ceil(4 * (F.col("n") + F.col("least")) / 9))
            & (5 * F.col("n") >= 4 * F.col("least")) & (4 * F.col("n") <= 5 * F.col("most"))
            & (F.struct("members", "component") < F.struct("k1_members", "k1")))
    asks = materialise(met.join(groups, (met["token"] == groups["token"]) & fits).select("class", "n", "component", "k1").distinct(),
                       "jaccard-candidates")
    # All the prefix shingles they share must make up for what may be shared beyond the prefixes.
    other = size.select(F.col("component").alias("k1"), "members", "low", "high")
    low = F.least("high", F.greatest("low", F.ceil(F.col("n") * 4 / 5)))
    high = F.greatest("low", F.least("high", F.floor(F.col("n") * 5 / 4)))
    asks = (asks.join(met.select("class", "token"), "class").join(groups.select("token", "k1"), ["token", "k1"])
            .groupBy("class", "n", "component", "k1").agg(F.count("*").alias("met")).join(other, "k1")
            .where(F.col("met") >= least_met_within(F.col("n"), low, high))
            .select("class", "component", "k1", "members"))
    asks = materialise(asks, "jaccard-asks")
    chunks = asks.groupBy("k1").agg(F.count("*").alias("asking"))
    asks = asks.join(chunks, "k1").withColumn("k3", F.pmod(F.xxhash64("class"), F.ceil(F.col("asking") / PROBES)))
    probes = asks.withColumn("k2", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("members") - 1) / TILE))))
    targets = (member.join(chunks, F.col("component") == F.col("k1")).withColumn("k2", tile_of("class", "members"))
               .withColumn("k3", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("asking") - 1) / PROBES)))))
    more = compare(targets, probes, texts, classes)

    joined = components(links.union(more), "jaccard-second")
    by_class = classes.join(joined, F.col("class") == F.col("node"), "left").select(
        "class", "first", F.coalesce("component", "class").alias("component"))
    lowest = by_class.groupBy("component").agg(F.min("first").alias("component_id"))
    by_class = by_class.join(lowest, "component").select("class", "component", "component_id")
    return rows, by_class


def least_met(n, m):
    """Prefix shingles that sets of n and m must share: beyond their prefixes at most ceil(0.8 of the larger) - 1 can be."""
    return F.ceil(4 * (n + m) / 9) - F.ceil(F.greatest(n, m) * 4 / 5) + 1


def least_met_within(n, low, high):
    """At most what `least_met` asks for with any size from `low` to `high`.

    Up to n it grows with the size. Above n it falls, but for steps up by one where one rounding moves and the other does not.
    """
    step = F.when((low < high) & (high > n), 1).otherwise(0)
    return F.least(least_met(n, low), least_met(n, high) - step)


def tile_of(name: str, total: str):
    """One of ceil(total / TILE) tiles, by hash."""
    return F.pmod(F.xxhash64(name), F.ceil(F.col(total) / TILE))


SQL_OP4 = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END) AS g
  FROM w WHERE w IS NOT NULL),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""


@query("op4_jaccard", SQL_OP4)
def op4_jaccard(spark, folder):
    return jaccard_components(table(spark, folder, "documents"))
