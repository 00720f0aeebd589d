"""A corpus pipeline of operators in `pagelib.llm`.

`documents` go through toxicity, the n-gram Jaccard join, substring dedup, mixing and SentencePiece coding. A stage takes
(spark, docs, sf_dir) and returns a DataFrame; `run` writes each stage's result as Parquet and reads it again for the
next. All but the last return the columns of `documents`; columns beyond those are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagelib.llm import jaccard, mixing, sentencepiece_codec, substrings, toxicity
from pagelib.llm.common import prepared
from pagelib.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that score below the cut stay, null and empty ones among them."""
    labels = prepared(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.with_toxicity(docs, labels).where(F.col("toxicity") < toxicity.CUT).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; of equal rows one stays.

    A document whose id is null, or that links with no other, stays.
    """
    prepared(spark)
    return jaccard.one_of_each(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its repeated passages go, and n_chars follows."""
    prepared(spark)
    clean = substrings.without_repeats(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
                            .cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document stands once for each pass that takes words of it, cut where the pass ends."""
    prepared(spark)
    mixed = mixing.mixed_texts(docs.select(*COLUMNS))
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every mixed text: their number, the hash of the ids and that of the decoded text."""
    prepared(spark)
    coded = sentencepiece_codec.with_codes(docs.select(*COLUMNS), sentencepiece_codec.default_model())
    return coded.select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_copies), ("substring_dedup", cut_repeats),
          ("source_mixing", mix_sources), ("sentencepiece", encode)]
ORACLE_SQL = None    # a learned score and a tokenizer have no SQL form; tests compare with brute force instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
