"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only.

A source's documents are laid end to end in hash order and cut into blocks of equal word counts. Its quota is its
target in words: whole passes over its blocks, then blocks in a permuted order of their own, the last one cut where
the quota ends. A binary tree hands the exact block quotas of all sources down to the output shards: at each node the
left half's share of every source is drawn without replacement, so the counts stay exact on every level. A shard then
owns a run of each source's drawn blocks, disjoint from every other shard's, and orders its slices by a hash.

Every random choice is a hash of the seed and of what it decides about: reruns and recomputed tasks agree.

Null or empty texts have size 0 and take nothing. A null source is one source of its own, after all others. Rows that
repeat are documents of their own. Other columns of the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagelib.functions import ordered
from pagelib.llm.common import WORD, query, small, table
from pagelib.session import materialise

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
SHARDS = 64              # a power of two
BLOCKS_PER_SHARD = 64
LAYOUT_BUCKETS = 4096    # of one source's hash order; its running sums are carried from bucket to bucket
SMALL_ROWS = 200_000     # rows a broadcast table may have; larger ones are joined by shuffle


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / F.lit(float(1 << 53))


def source_targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_no, source_size, total, target): shares by weight, none above `most` times its source.

    With sources in the order of cap / weight, everything capped stands first, and the level that the rest share is
    the largest of (total - caps before) / (weights from here on). One row per source is windowed, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    first = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before = first.rowsBetween(Window.unboundedPreceding, -1)
    onward = first.rowsBetween(0, Window.unboundedFollowing)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    return (sized.groupBy("source").agg(F.sum("size").alias("source_size"))
            .withColumn("source_no", F.row_number().over(by_name))
            .withColumn("weight", F.element_at(turn, ((F.col("source_no") - 1) % len(weights) + 1).cast("int")))
            .withColumn("cap", F.lit(most) * F.col("source_size"))
            .withColumn("total", F.sum("source_size").over(everything))
            .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
                        / F.sum("weight").over(onward))
            .withColumn("level", F.max("level").over(everything))
            .withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")))
            .select("source", "source_no", "source_size", "total", "target"))


def drawn_blocks(targets: DataFrame, shards: int, blocks_per_shard: int, seed: int) -> DataFrame:
    """(source_no, block, epoch, from, cut, draw): the blocks each source gives, numbered in permuted order.

    `from` is the block's first word in the source's layout, `cut` the words taken of it. There are at most
    `MOST_REPEATS` rows for each of shards * blocks_per_shard blocks, plus as many for each source.
    """
    order = Window.partitionBy("source_no", "epoch").orderBy("lot", "block")
    lots = F.xxhash64(F.lit(seed), "source_no", "epoch", "block")
    return (targets.where("source_size > 0")
            .withColumn("width", block_width(shards, blocks_per_shard))
            .withColumn("quota", F.round("target").cast("long"))
            .withColumn("passes", F.floor(F.col("quota") / F.col("source_size")))
            .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
            .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"),
                                                      F.floor((F.col("source_size") - 1) / F.col("width")))))
            .withColumn("from", F.col("block") * F.col("width"))
            .withColumn("words", F.least("width", F.col("source_size") - F.col("from")))
            .withColumn("lot", lots)
            .withColumn("before", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)))
            .withColumn("left", F.col("quota") - F.col("epoch") * F.col("source_size")
                        - F.coalesce("before", F.lit(0)))
            .withColumn("cut", F.least("words", "left")).where("cut > 0")
            .withColumn("draw", F.row_number().over(Window.partitionBy("source_no").orderBy("epoch", "lot", "block"))
                        .cast("long"))
            .select("source_no", "block", "epoch", "from", "cut", "draw"))


def block_width(shards: int, blocks_per_shard: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(shards * blocks_per_shard))).cast("long")


def split_node(counts: Column, room: Column, total: Column, *salt: Column) -> Column:
    """How many of each source's blocks go left: `room` of `total` places, drawn source by source without replacement.

    Each block in turn goes left with probability (places left) / (blocks left): together a multivariate
    hypergeometric draw, exact and with no table of probabilities.
    """
    zero = F.lit(0).cast("long")
    start = F.struct(room.alias("room"), total.alias("rest"), F.array().cast("array<long>").alias("out"))

    def one_source(state, count):
        def one_block(urn, i):
            hit = (uniform(*salt, F.size(state["out"]), i) * urn["rest"] < urn["room"]).cast("long")
            return F.struct((urn["room"] - hit).alias("room"), (urn["rest"] - 1).alias("rest"))

        blocks = F.when(count > 0, F.sequence(F.lit(1).cast("long"), count)).otherwise(F.array().cast("array<long>"))
        after = F.aggregate(blocks, F.struct(state["room"].alias("room"), state["rest"].alias("rest")), one_block)
        return F.transform(F.array(after), lambda urn: F.struct(
            urn["room"].alias("room"), urn["rest"].alias("rest"),
            F.concat(state["out"], F.array(state["room"] - urn["room"])).alias("out")))[0]

    return F.when(total > zero, F.aggregate(counts, start, one_source)["out"]).otherwise(counts)


def splitting_tree(drawn: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, source_no, first, last): the run of draw numbers of each source that a shard owns."""
    quotas = drawn.groupBy("source_no").agg(F.count("*").alias("n"))
    nodes = (quotas.agg(F.sort_array(F.collect_list(F.struct("source_no", "n"))).alias("quotas"), F.sum("n").alias("all"))
             .select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), F.col("all"),
                     F.col("quotas.source_no").alias("names"), F.col("quotas.n").alias("counts")))
    place = lambda c: F.floor(F.col("all") * c / F.lit(shards))
    for _ in range(shards.bit_length() - 1):
        mid = ((F.col("lo") + F.col("hi")) / 2).cast("long")
        nodes = (nodes.withColumn("mid", mid)
                 .withColumn("left", split_node(F.col("counts"), place(F.col("mid")) - place(F.col("lo")),
                                                place(F.col("hi")) - place(F.col("lo")), F.lit(seed), F.col("lo"), F.col("hi")))
                 .withColumn("right", F.zip_with("counts", "left", lambda c, gone: c - gone))
                 .select("all", "names", F.explode(F.array(
                     F.struct(F.col("lo"), F.col("mid").alias("hi"), F.col("left").alias("counts")),
                     F.struct(F.col("mid").alias("lo"), F.col("hi"), F.col("right").alias("counts")))).alias("half"))
                 .select("all", "names", "half.*"))
    before = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return (nodes.select(F.col("lo").alias("shard"), F.explode(F.arrays_zip("names", "counts")).alias("x"))
            .select("shard", F.col("x.names").alias("source_no"), F.col("x.counts").alias("n"))
            .withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)) + 1)
            .withColumn("last", F.col("first") + F.col("n") - 1).where("n > 0").drop("n"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, shards: int = SHARDS,
        blocks_per_shard: int = BLOCKS_PER_SHARD, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Plan a mix of `docs` (doc_id, text, source).

    Returns the documents (row key, doc_id, size, source_size, target, start) and the slices that the mix takes
    (shard, place, row key, doc_id, epoch, first_word, n_words). Words are numbered from 0 in a document. The row key
    is (source_no, start, doc_id, text_hash); rows of size 0 have no slice.
    """
    spark = docs.sparkSession
    sized = materialise(docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"),
                                    F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")),
                        "mix-sizes")
    targets = materialise(source_targets(sized, weights, most), "mix-targets")
    drawn = materialise(drawn_blocks(targets, shards, blocks_per_shard, seed), "mix-draws")
    owned = splitting_tree(drawn, shards, seed).withColumn("draw", F.explode(F.sequence("first", "last")))
    blocks = materialise(drawn.join(owned.select("shard", "source_no", "draw"), ["source_no", "draw"]), "mix-blocks")

    named = small(targets, SMALL_ROWS)
    numbered = (sized.join(named, sized["source"].eqNullSafe(named["source"]))
                .select("doc_id", sized["source"], "text_hash", "size", "source_no", "source_size", "target",
                        block_width(shards, blocks_per_shard).alias("width"),
                        F.xxhash64(F.lit(seed), "doc_id", "text_hash").alias("lot")))
    order = [F.col("lot"), F.col("doc_id"), F.col("text_hash"), F.col("size")]
    bucket = F.floor(F.col("lot") / F.lit(float((1 << 64) // LAYOUT_BUCKETS)))
    laid = ordered.running(numbered, ["source_no"], order, [ordered.Coarse(bucket)], "end", F.col("size"))
    laid = materialise(laid.withColumn("start", F.col("end") - F.col("size")).drop("lot"), "mix-layout")

    first, last = F.floor(F.col("start") / F.col("width")), F.floor((F.col("end") - 1) / F.col("width"))
    begin = F.greatest("start", "from")
    slices = (laid.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
              .join(small(blocks, SMALL_ROWS), ["source_no", "block"])
              .withColumn("n_words", F.least("end", F.col("from") + F.col("cut")) - begin).where("n_words > 0")
              .select("shard", F.xxhash64(F.lit(seed), "source_no", "epoch", begin).alias("place"), "source_no", "start",
                      "doc_id", "text_hash", "size", "epoch", (begin - F.col("start")).alias("first_word"), "n_words"))
    return laid, slices


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: one row per document and pass, with the words that the pass takes.

    A pass that takes all words keeps the text as it is; a part keeps the taken words with the white space before
    each. Columns are those of `docs`, with `shard` and `place` (these names are replaced); rows equal in doc_id, source
    and text are copies and share their other columns. Within a shard the rows stand in the order of `place`.
    """
    laid, slices = mix(docs, **options)
    parts = (slices.groupBy("source_no", "start", "doc_id", "text_hash", "size", "epoch")
             .agg(F.sum("n_words").alias("__taken"), F.min(F.struct("place", "shard")).alias("__at"),
                  F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias("__runs"))
             .select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), (F.col("__taken") < F.col("size")).alias("__part"),
                     "__at", "__runs", "source_no"))
    # The source's number tells apart rows that share doc_id and text.
    named = small(laid.select("source_no", "source").distinct(), SMALL_ROWS).select(F.col("source_no"), F.col("source").alias("__source"))
    parts = parts.join(named, "source_no").drop("source_no")
    others = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    texts = (docs.where("text is not null").withColumn("__text_hash", F.xxhash64("text"))
             .groupBy("doc_id", "source", "__text_hash").agg(F.max(F.struct("text", *others)).alias("__row")))
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("__runs", lambda r: F.slice("__pieces", (r["first_word"] + 1).cast("int"),
                                                                        r["n_words"].cast("int")))), "")
    joined = texts.join(parts, (F.col("__text_hash") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__doc"))
                        & F.col("source").eqNullSafe(F.col("__source")))
    return (joined.select("doc_id", "source", "__row.*", "__part", "__runs", "__at")
            .withColumn("__pieces", F.when(F.col("__part"), pieces))
            .withColumn("text", F.when(F.col("__part"), cut).otherwise(F.col("text")))
            .select(*[c for c in docs.columns if c not in ("shard", "place")], "__at.shard", "__at.place"))


@query("op1_mixing")
def op1_mixing(spark, folder):
    laid, slices = mix(table(spark, folder, "documents"))
    key = ["source_no", "start", "doc_id", "text_hash", "size"]
    took = slices.groupBy(*key).agg(F.sum("n_words").alias("taken"), F.min("shard").alias("first_shard"),
                                    F.max("shard").alias("last_shard"))
    full = [F.col(k).eqNullSafe(F.col(f"t_{k}")) for k in key]
    took = took.select(*[F.col(k).alias(f"t_{k}") for k in key], "taken", "first_shard", "last_shard")
    return (laid.join(took, (F.col("size") > 0) & full[0] & full[1] & full[2] & full[3] & full[4], "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
                    "first_shard", "last_shard"))
