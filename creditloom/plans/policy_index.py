"""Policy passages: index a folder of texts, then find and cite passages for questions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.operators import retrieval, term_index
from creditloom.operators.latest import latest_per_key
from creditloom.session import configure, write_stage
from creditloom.sources.landing import read_documents
from creditloom.sources.snapshots import read_parts, replace_part

_COUNTED = ["id", "terms", "counts"]


def _frequencies(spark: SparkSession, index_dir: str, chunks: DataFrame) -> DataFrame:
    """Chunks that have each term: as stored, or counted anew where a writer died in between."""
    version = chunks.first()["version"]
    stored = read_parts(spark, f"{index_dir}/frequencies")
    if stored is not None:
        fitting = stored.where(F.col("version") == version)
        if not fitting.isEmpty():
            return fitting.select("term", "n")
    return term_index.frequencies(chunks)


def build_index(spark: SparkSession, docs_dir: str, index_dir: str, reset: bool = False) -> int:
    """Chunk the texts of a folder and count their terms; returns the chunks in the index.

    Chunks are put in by id, so a repeated run changes nothing; ``reset`` drops what was there.
    Only new and changed chunks are counted.  Term weights belong to the whole collection, so
    they are not stored: the frequencies are a small table to which changes are added.
    """
    configure(spark)
    docs = read_documents(spark, docs_dir)
    found = retrieval.chunk_documents(docs, filename="filename").select("id", "text", "metadata")
    found = write_stage(latest_per_key(found, ["id"], [F.col("text")]), "chunks")
    if found.isEmpty():
        raise ValueError(f"no text chunks in {docs_dir}")
    old = None if reset else read_parts(spark, f"{index_dir}/chunks")
    new = found if old is None else found.join(old.select("id", "text"), ["id", "text"], "left_anti")
    counted = write_stage(new.join(term_index.counted(new), "id"), "counted")
    merged, frequencies = counted, term_index.frequencies(counted)
    if old is not None:
        if counted.isEmpty():
            return old.count()
        stays = old.join(counted.select("id"), "id", "left_anti")
        goes = old.join(counted.select("id"), "id", "left_semi")
        merged = stays.select(*counted.columns).unionByName(counted)
        before = _frequencies(spark, index_dir, old)
        frequencies = term_index.merged_frequencies(
            before, frequencies, term_index.frequencies(goes)
        )
    version = F.lit(uuid.uuid4().hex).alias("version")
    merged = write_stage(merged.select("*", version), "merged-chunks")
    frequencies = write_stage(frequencies.select("term", "n", version), "frequencies")
    replace_part(merged, f"{index_dir}/chunks")
    replace_part(frequencies, f"{index_dir}/frequencies")
    return merged.count()


def retrieve(
    spark: SparkSession, index_dir: str, questions: DataFrame, k: int = retrieval.TOP_K
) -> DataFrame:
    """The k nearest passages of every question (query_id, question): cited, ranked rows."""
    chunks = read_parts(spark, f"{index_dir}/chunks")
    if chunks is None:
        raise LookupError(f"no index in {index_dir}")
    frequencies = _frequencies(spark, index_dir, chunks)
    index = term_index.build_index(chunks.select(*_COUNTED), frequencies)
    hits, _ = term_index.search(index, term_index.counted(questions, "query_id", "question"), k)
    passages = chunks.select(
        "id",
        "text",
        F.col("metadata.source").alias("source"),
        F.col("metadata.filename").alias("filename"),
        F.col("metadata.section").alias("section"),
        F.col("metadata.chunk_index").alias("chunk_index"),
    )
    return retrieval.cited_hits(hits, passages, vector_id="id")
