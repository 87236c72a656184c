"""Corpus pipeline: stages over the documents, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm import decontamination, line_dedup, sentencepiece_codec, simhash, toxicity
from creditloom.llm.common import stage, table
from creditloom.session import configure

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3; learned on the labels of ``sf_dir``."""
    return toxicity.drop_toxic(docs, table(configure(spark), sf_dir, "labels"))


def drop_shared_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of 50 words or more that stand in earlier ones.

    All rows stay; a copy of an earlier document is left with an empty text.
    """
    configure(spark)
    rest = line_dedup.dedup_lines(docs)
    return rest.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates."""
    configure(spark)
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth stands in windows of the benchmark."""
    return decontamination.drop_contaminated(docs, table(configure(spark), sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    configure(spark)
    return sentencepiece_codec.round_trip(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_shared_blocks),
    ("SimHash near-dedup", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ``sf_dir`` through all stages."""
    docs = table(configure(spark), sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
