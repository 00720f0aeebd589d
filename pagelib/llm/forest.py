"""Embedding near-duplicates by a forest of random-projection trees.

Equal vectors are one class. Each tree halves a bounded sample again and again, at the median of its projections on a
random direction, and every vector of the table then goes down all trees; one that lies close to a split goes down both
sides (spill). A leaf that the table fills beyond MOST_ROWS is split further in the same way, by a tree fitted on a hash
sample of its own rows, level by level, so leaves stay bounded at any table size. Only where a split would leave both
sides nearly whole does a leaf stay: its vectors lie closer together than the spill band is wide, so most of them link
with each other and their comparison is the work that their links are. Vectors of a leaf are compared exactly, in tiles
if there are many. A pair is counted in the smallest leaf that both share and nowhere else; so a tile sends one count for
each vector and the edges of a spanning forest, never its pairs. Components are the union over all leaves.

A deeper tree parts more near pairs, so the number of trees doubles with every five levels below the seventh.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Shorter vectors count as
padded with zeros. Rows that repeat are vectors of their own and link with each other. A null id is never the smallest.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from pagelib.llm.common import components, query, small, table
from pagelib.llm.topk import finite, matrix
from pagelib.session import materialise

COSINE = 0.95
TREES = 8                # of a table whose trees are at most FLAT levels deep
FLAT = 7
SPILL = 0.096            # half width of the band around a split that goes both ways, times the root of the dimensions
SHRINK = 0.65            # most of a node's vectors that a side may keep for the split to be worth its copies
SAMPLE = 16_384          # vectors that the trees are fitted on, chosen by hash
LEAF = 400               # vectors a leaf should hold
MOST_ROWS = 4 * LEAF     # a leaf with more is split again
LEAST_SAMPLE = 64        # of a leaf
FIT = 4_096              # vectors of a leaf that its own tree is fitted on, chosen by hash
BLOCK = 8_192            # vectors that one task takes down a leaf's own tree at a time
TILE = 1024


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)     # so that no square overflows or vanishes
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def as_unit(dims: int):
    """Vectors of length 1 as bytes."""
    @pandas_udf("binary")
    def go(v: pd.Series) -> pd.Series:
        return pd.Series([x.tobytes() for x in unit(matrix(v, dims))], dtype=object)

    return go


class Tree:
    """Split directions and thresholds by node; leaves are numbered from left to right."""

    def __init__(self, sample: np.ndarray, leaf: int, spill: float, rng: np.random.Generator):
        self.direction: list[np.ndarray | None] = []
        self.cut: list[float] = []
        self.child: list[tuple[int, int]] = []
        self.leaves = 0
        self._grow(sample, leaf, spill, rng)

    def _grow(self, sample: np.ndarray, leaf: int, spill: float, rng: np.random.Generator) -> int:
        node = len(self.cut)
        self.direction.append(None)
        self.cut.append(0.0)
        self.child.append((self.leaves, -1))
        if len(sample) > leaf:
            d = rng.standard_normal(sample.shape[1])
            d /= np.linalg.norm(d)
            p = sample @ d
            cut = float(np.median(p))
            left, right = p - cut <= spill, p - cut > -spill
            if max(left.sum(), right.sum()) <= SHRINK * len(p):
                self.direction[node], self.cut[node] = d, cut
                self.child[node] = (self._grow(sample[left], leaf, spill, rng), self._grow(sample[right], leaf, spill, rng))
                return node
        self.child[node] = (self.leaves, -1)
        self.leaves += 1
        return node

    def leaves_of(self, m: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs; a row near a split has several."""
        rows, leaves, stack = [], [], [(0, np.arange(len(m)))]
        while stack:
            node, at = stack.pop()
            if not len(at):
                continue
            if self.direction[node] is None:
                rows.append(at)
                leaves.append(np.full(len(at), self.child[node][0]))
                continue
            p = m[at] @ self.direction[node] - self.cut[node]
            stack.append((self.child[node][0], at[p <= spill]))
            stack.append((self.child[node][1], at[p > -spill]))
        return np.concatenate(rows), np.concatenate(leaves)


def leaf_of_sample(sample: int, total: int, held: int, least: int) -> int:
    """Sample vectors of a leaf that should hold `held` of `total`."""
    return max(least, int(held * sample / max(total, 1)))


def trees_for(total: int) -> int:
    """TREES up to FLAT levels, twice as many for each five levels more."""
    depth = np.log2(max(total / LEAF, 1))
    return int(np.ceil(TREES * 2 ** (max(0.0, depth - FLAT) / 5)))


def plant(sample: np.ndarray, total: int, trees: int, spill: float, seed: int) -> list[Tree]:
    leaf = leaf_of_sample(len(sample), total, LEAF, LEAST_SAMPLE)
    return [Tree(sample, leaf, spill, np.random.default_rng([seed, t])) for t in range(trees)]


PLACED = "leaf long, child long, final boolean, class long, copies long, v binary"


def place(forest, dims: int, spill: float):
    """Each vector once for each of its leaves."""
    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            m = unit(matrix(batch["v"], dims))
            vectors = np.array([v.tobytes() for v in m], dtype=object)
            for t, tree in enumerate(forest.value):
                row, leaf = tree.leaves_of(m, spill)
                yield pd.DataFrame({"leaf": t, "child": leaf.astype(np.int64), "final": False,
                                    "class": batch["class"].to_numpy()[row], "copies": batch["copies"].to_numpy()[row],
                                    "v": vectors[row]})

    return go


def place_again(spill: float, seed: int, held: int, least: int):
    """A block of a crowded leaf goes down the tree that the leaf's sample gives, the same one in every block."""
    def go(rows: pd.DataFrame, sample: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({c.split()[0]: [] for c in PLACED.split(", ")})
        leaf, n = int(rows["leaf"].iat[0]), int(rows["n"].iat[0])
        chosen = sample.sort_values("class")["v"]
        m = np.frombuffer(b"".join(rows["v"]), dtype=np.float64).reshape(len(rows), -1)
        points = np.frombuffer(b"".join(chosen), dtype=np.float64).reshape(-1, m.shape[1])
        tree = Tree(points, leaf_of_sample(len(points), n, held, least), spill, np.random.default_rng([seed, leaf]))
        row, child = tree.leaves_of(m, spill)
        return pd.DataFrame({"leaf": leaf, "child": child.astype(np.int64), "final": tree.leaves == 1,
                             "class": rows["class"].to_numpy()[row], "copies": rows["copies"].to_numpy()[row],
                             "v": rows["v"].to_numpy()[row]})

    return go


def named(placed: DataFrame) -> DataFrame:
    """The child of a leaf as a leaf of its own; names are not negative."""
    return placed.withColumn("leaf", F.shiftrightunsigned(F.xxhash64("leaf", "child"), 1)).drop("child")


def split_crowded(placed: DataFrame, spill: float, seed: int) -> DataFrame:
    """(class, leaf) of all vectors, with no leaf over MOST_ROWS that a split can help."""
    done = []
    while True:
        sizes = materialise(placed.where("not final").groupBy("leaf").agg(F.count("*").alias("n"))
                            .where(F.col("n") > MOST_ROWS), "forest-crowded")
        crowded = sizes.count()
        if not crowded:
            done.append(placed.select("class", "leaf"))
            break
        sizes = small(sizes, 1 << 17)
        done.append(placed.join(sizes, "leaf", "left_anti").select("class", "leaf"))
        rows = placed.join(sizes, "leaf").select("leaf", "n", "class", "copies", "v")
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        lot = F.pmod(F.xxhash64("class", "leaf", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
        sample = rows.where(lot < FIT / F.col("n")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        blocked = rows.withColumn("block", F.pmod(F.xxhash64("class", F.lit(1)), blocks).cast("int"))
        sample = sample.select(*[F.col(c).alias(c) for c in ("leaf", "block", "class", "v")])     # columns of their own
        placed = materialise(named(
            blocked.groupBy("leaf", "block").cogroup(sample.groupBy("leaf", "block"))
            .applyInPandas(place_again(spill, seed, LEAF, LEAST_SAMPLE), PLACED)), "forest-leaves")
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    return found


def padded(lists: pd.Series) -> np.ndarray:
    """Leaf lists as one array; ends are filled with -1."""
    sizes = np.array([len(x) for x in lists])
    out = np.full((len(lists), sizes.max()), -1, dtype=np.int64)
    out[np.arange(sizes.max())[None, :] < sizes[:, None]] = np.concatenate(lists.to_list())
    return out


def met_before(a: np.ndarray, b: np.ndarray, leaf: int) -> np.ndarray:
    """Whether rows of two padded leaf lists share a leaf below `leaf`; in slices, so that memory stays bounded."""
    out = np.zeros(len(a), dtype=bool)
    for s in range(0, len(a), 100_000):
        x, y = a[s:s + 100_000], b[s:s + 100_000]
        for k in range(x.shape[1]):
            c = x[:, k:k + 1]
            out[s:s + 100_000] |= ((c == y) & (c >= 0) & (c < leaf)).any(axis=1)
    return out


def compare_tile(cosine: float):
    """Links inside one tile: counts by class, and a spanning forest of them (rows with links 0)."""
    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        leaf = int(frame["leaf"].iat[0])
        m = np.frombuffer(b"".join(frame["v"]), dtype=np.float64).reshape(len(frame), -1)
        names, copies, side = (frame[c].to_numpy() for c in ("class", "copies", "side"))
        lists = padded(frame["leaves"])
        near = (m @ m.T) >= cosine
        # A tile of two different blocks compares across them only; a tile of one block compares each pair once.
        near &= (side[:, None] < side[None, :]) if side.any() else np.triu(np.ones_like(near), 1)
        i, j = np.nonzero(near)
        if not len(i):
            return pd.DataFrame({"a": [], "b": [], "links": []}, dtype="int64")
        both = near | near.T
        label = np.arange(len(m))
        while True:
            low = np.minimum(label, np.where(both, label[None, :], len(m)).min(axis=1))
            low = low[low]
            if (low == label).all():
                break
            label = low
        own = ~met_before(lists[i], lists[j], leaf)
        links = np.zeros(len(m), dtype=np.int64)
        np.add.at(links, i[own], copies[j[own]])
        np.add.at(links, j[own], copies[i[own]])
        tied, counted = np.flatnonzero(label != np.arange(len(m))), np.flatnonzero(links)
        return pd.DataFrame({"a": np.concatenate([names[tied], names[counted]]),
                             "b": np.concatenate([names[label[tied]], names[counted]]),
                             "links": np.concatenate([np.zeros(len(tied), dtype=np.int64), links[counted]])})

    return compare


def forest_leaves(classes: DataFrame, total: int, dims: int, trees: int, spill: float, sample: int, seed: int) -> DataFrame:
    """(class, leaf), each class once for each of its leaves in all trees."""
    lot = F.pmod(F.xxhash64("class", F.lit(seed)), F.lit(1 << 20))
    chosen = classes.where(lot < int((1 << 20) * min(1.0, sample / max(total, 1)))).select("v").toPandas()
    points = unit(matrix(chosen["v"], dims)) if len(chosen) else np.zeros((0, dims))
    forest = classes.sparkSession.sparkContext.broadcast(plant(points, total, trees, spill, seed))
    placed = classes.select("class", "copies", "v").mapInPandas(place(forest, dims, spill), PLACED)
    return split_crowded(materialise(named(placed), "forest-leaves"), spill, seed)


def tiles_of(classes: DataFrame, leaves: DataFrame) -> DataFrame:
    """Rows of each pair of blocks of a leaf that one task compares, with all leaves of a vector."""
    lists = leaves.groupBy("class").agg(F.collect_set("leaf").alias("leaves"))   # some per tree
    sizes = leaves.groupBy("leaf").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / TILE).cast("int")
    dealt = (classes.select("class", "copies", "v").join(lists, "class").withColumn("leaf", F.explode("leaves"))
             .join(small(sizes, 1 << 17), "leaf").withColumn("block", F.pmod(F.xxhash64("class"), blocks).cast("int")))
    others = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(
        F.least(F.col("block"), o).alias("x"), F.greatest(F.col("block"), o).alias("y"), (F.col("block") > o).cast("int").alias("side")))
    return dealt.withColumn("t", F.explode(others)).select("leaf", "t.x", "t.y", "t.side", "class", "copies", "v", "leaves")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, trees: int | None = None, spill: float = SPILL,
                    sample: int = SAMPLE, seed: int = 5) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of `vectors` (vec_id, embedding)."""
    usable = finite("embedding") & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", F.when(usable, F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    rows = rows.withColumn("class", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    classes = materialise(rows.where("class is not null").groupBy("class")
                          .agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("first")),
                          "forest-classes")
    total, dims = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    dims = dims or 1
    leaves = forest_leaves(classes, total, dims, trees or trees_for(total), spill / dims ** 0.5, sample, seed)
    units = classes.withColumn("v", as_unit(dims)("v"))
    found = materialise(tiles_of(units, leaves).groupBy("leaf", "x", "y").applyInPandas(
        compare_tile(cosine), "a long, b long, links long"), "forest-links")

    joined = components(found.where("links = 0").select("a", "b"), "forest-components")
    links = found.where("links > 0").groupBy("a").agg(F.sum("links").alias("links"))
    by_class = (classes.select("class", "copies", "first").join(joined, F.col("class") == F.col("node"), "left")
                .join(links, F.col("class") == F.col("a"), "left")
                .select("class", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                        F.coalesce("component", "class").alias("component")))
    lowest = by_class.groupBy("component").agg(F.min("first").alias("component_id"))
    by_class = by_class.join(lowest, "component").select("class", "n_links", "component_id")
    own = F.coalesce("component_id", "vec_id")
    return (rows.select("vec_id", "class").join(by_class, "class", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"),
                    F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept")))


SQL_OP8 = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(vec_id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT d.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, d.vec_id = c.component_id AS kept
FROM embeddings d JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""


@query("op8_forest", SQL_OP8)
def op8_forest(spark, folder):
    return near_duplicates(table(spark, folder, "embeddings").select("vec_id", "embedding"))
