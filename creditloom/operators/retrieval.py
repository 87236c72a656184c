"""Document retrieval: chunk, embed, nearest passages, cited context, prompts."""

from __future__ import annotations

from pyspark.ml.feature import IDF, HashingTF, IDFModel, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.text import percent, section_name, short_hash, strip
from creditloom.operators import vector_index
from creditloom.operators.latest import latest_per_key, upsert
from creditloom.session import spread

# Chunk sizes, id layout, result size, separators and headings.
MAX_CHUNK_CHARS = 800
MIN_CHUNK_CHARS = 30
ID_TEXT_CHARS = 50
TOP_K = 5
EXCERPT_CHARS = 200
CONTEXT_RULE = "\n\n---\n\n"
POLICY_HEADING = "RELEVANT POLICY CONTEXT:\n\n"
CUSTOMER_HEADING = "\nCUSTOMER RISK PROFILE:\n"
DRIVER_HEADING = "\nSHAP RISK DRIVERS:\n"
QUESTION_HEADING = "\nCREDIT ANALYST QUESTION:\n"
QUESTION_CLOSING = "\n\nProvide a thorough, policy-grounded answer with source citations."
ASSESSMENT_QUESTION = (
    "Provide a complete credit risk assessment for application %s. Explain the key risk "
    "factors, cite relevant policy thresholds, and give a clear approve/decline recommendation "
    "with rationale."
)

#: Default instructions in front of every prompt; callers may pass their own.
ANALYST_INSTRUCTIONS = (
    "You assist a retail credit officer. Answer from the numbered policy passages and cite "
    "them as [Source N]. Use the customer's default probability and risk drivers when they "
    "are given. If the passages do not settle the question, say so; do not invent thresholds. "
    "Give the answer, its policy basis and a recommendation."
)


# --------------------------------------------------------------------------- chunks


def _pack_lines(paragraph: Column, limit: int) -> Column:
    """Greedy packing of the lines of one long paragraph; an over-long line stays whole."""
    lines = F.filter(
        F.transform(F.split(paragraph, "\n"), strip), lambda line: F.length(line) > 0
    )
    none = F.array().cast("array<string>")

    def add(state: Column, line: Column) -> Column:
        done, current = state["done"], state["current"]
        fits = F.length(current) + F.length(line) + 1 <= limit
        empty = F.length(current) == 0
        joined = F.when(empty, line).otherwise(F.concat(current, F.lit("\n"), line))
        return F.struct(
            F.when(fits | empty, done).otherwise(F.array_append(done, current)).alias("done"),
            F.when(fits, joined).otherwise(line).alias("current"),
        )

    def finish(state: Column) -> Column:
        current = state["current"]
        return F.when(F.length(current) > 0, F.array_append(state["done"], current)).otherwise(
            state["done"]
        )

    start = F.struct(none.alias("done"), F.lit("").alias("current"))
    return F.aggregate(lines, start, add, finish)


def chunk_texts(
    text: Column, limit: int = MAX_CHUNK_CHARS, minimum: int = MIN_CHUNK_CHARS
) -> Column:
    """Array of chunks of a text: paragraphs, long ones packed line by line."""
    paragraphs = F.filter(
        F.transform(F.split(text, "\n\n"), strip), lambda p: F.length(p) > 0
    )
    pieces = F.flatten(
        F.transform(
            paragraphs,
            lambda p: F.when(F.length(p) <= limit, F.array(p)).otherwise(_pack_lines(p, limit)),
        )
    )
    return F.filter(pieces, lambda c: F.length(c) > minimum)


def chunk_documents(
    docs: DataFrame, source: str = "source", text: str = "text", filename: str | None = None
) -> DataFrame:
    """One row per chunk: id, text and a metadata struct; every document is chunked in its row."""
    file = F.concat(F.col(source).cast("string"), F.lit(".txt")) if filename is None else filename
    split = spread(docs).select(
        F.col(source).cast("string").alias("_source"),
        (file if isinstance(file, Column) else F.col(file)).alias("_file"),
        chunk_texts(F.col(text)).alias("_chunks"),
    )
    rows = split.select(
        "_source",
        "_file",
        F.size("_chunks").alias("_total"),
        F.posexplode("_chunks").alias("_index", "text"),
    )
    key = F.concat(
        "_source",
        F.lit("::"),
        F.col("_index").cast("string"),
        F.lit("::"),
        F.substring("text", 1, ID_TEXT_CHARS),
    )
    return rows.select(
        short_hash(key).alias("id"),
        "text",
        F.struct(
            F.col("_source").alias("source"),
            F.col("_file").alias("filename"),
            section_name(F.col("text")).alias("section"),
            F.col("_index").alias("chunk_index"),
            F.length("text").alias("char_count"),
            F.col("_total").alias("total_chunks"),
        ).alias("metadata"),
    )


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Chunk count and sizes per source."""
    size = F.col("metadata.char_count")
    return chunks.groupBy(F.col("metadata.source").alias("source")).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.sum(size).alias("chars"),
        F.min(size).alias("shortest"),
        F.max(size).alias("longest"),
    )


def upsert_chunks(collection: DataFrame, chunks: DataFrame) -> DataFrame:
    """The collection with new and changed chunks put in by id; of equal ids the first text."""
    return upsert(collection, latest_per_key(chunks, ["id"], [F.col("text")]), ["id"])


# --------------------------------------------------------------------------- vectors

EMBEDDING_SIZE = 384


def _term_counts(df: DataFrame, text: str, size: int) -> DataFrame:
    tokens = RegexTokenizer(inputCol=text, outputCol="_terms", pattern=r"[^\p{L}\p{N}]+")
    hashed = HashingTF(inputCol="_terms", outputCol="_counts", numFeatures=size)
    return hashed.transform(tokens.transform(df)).drop("_terms")


def fit_embedding(texts: DataFrame, text: str = "text", size: int = EMBEDDING_SIZE) -> IDFModel:
    """Term weights of a corpus: one distributed pass, a vector of ``size`` numbers."""
    return IDF(inputCol="_counts", outputCol="_weighted").fit(_term_counts(texts, text, size))


def embed(df: DataFrame, model: IDFModel, text: str = "text") -> DataFrame:
    """Add ``embedding``: the unit-length TF-IDF vector of a text, hashed to a fixed size.

    Any encoder with the same contract (a text column in, a unit array<float> out) can take
    its place in front of :func:`vector_topk`.
    """
    weighted = model.transform(_term_counts(df, text, model.idf.size))
    unit = Normalizer(inputCol="_weighted", outputCol="_unit", p=2.0).transform(weighted)
    vector = vector_to_array("_unit", "float32")
    return unit.withColumn("embedding", vector).drop("_counts", "_weighted", "_unit")


def centroids(vectors: DataFrame, group: str, embedding: str = "embedding") -> DataFrame:
    """Mean vector per group, merged on the map side."""
    mean = Summarizer.mean(array_to_vector(F.col(embedding).cast("array<double>")))
    grouped = vectors.groupBy(group).agg(mean.alias("_mean"))
    return grouped.select(group, vector_to_array("_mean").alias(embedding))


def vector_topk(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = TOP_K,
    query_id: str = "query_id",
    vector_id: str = "vec_id",
    embedding: str = "embedding",
    query_block: int = vector_index.BLOCK_QUERIES,
) -> DataFrame:
    """The k nearest vectors of every query by cosine distance: (query_id, rank, vec_id, distance).

    Exact: an index of the vectors is built and searched (see :mod:`vector_index`); callers with
    many sets of queries build it once.  ``query_block`` queries of a cell go to one task.
    """
    index = vector_index.build_index(vectors, vector_id, embedding)
    hits, _ = vector_index.search(index, queries, k, query_id, embedding, query_block)
    return hits.withColumnsRenamed({"query_id": query_id, "vector_id": vector_id})


# --------------------------------------------------------------------------- context, prompts


def cited_hits(hits: DataFrame, passages: DataFrame, vector_id: str = "vec_id") -> DataFrame:
    """Hits with source, section, excerpt and text; ``passages`` has one row per vector id.

    There are k hits per query while the passages are the whole collection, so the hits are
    the side Spark may broadcast by its measured size.
    """
    excerpt = F.substring("text", 1, EXCERPT_CHARS)
    return (
        passages.join(hits, vector_id)
        .withColumn("excerpt", excerpt)
        .withColumn("distance", F.round("distance", 4))
    )


def context_blocks(cited: DataFrame, query_id: str = "query_id") -> DataFrame:
    """One numbered context text per query; at most k passages are gathered per query."""
    block = F.concat(
        F.lit("[Source "),
        F.col("rank").cast("string"),
        F.lit(": "),
        F.col("source"),
        F.lit(" — "),
        F.col("section"),
        F.lit("]\n"),
        F.col("text"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    joined = F.array_join(F.transform(ordered, lambda x: x["block"]), CONTEXT_RULE)
    return cited.groupBy(query_id).agg(
        joined.alias("policy_context"), F.count(F.lit(1)).alias("n_sources")
    )


def application_context(latest: DataFrame, drivers: DataFrame) -> DataFrame:
    """What a prompt says about an application: its score and its drivers, one row each.

    ``latest`` has one row and ``drivers`` one ``driver_text`` row per application.
    """
    line = {
        "Application ID ": F.col("application_id"),
        "Customer ID    ": F.col("customer_id"),
        "PD Probability ": percent(F.col("pd_probability_ens"), 2),
        "Risk Grade     ": F.concat("risk_grade", F.lit("  (A=lowest, E=highest)")),
        "Model Version  ": F.col("model_version"),
    }
    profile = F.array_join(
        F.array(*[F.concat(F.lit(f"  {name}: "), value) for name, value in line.items()]), "\n"
    )
    scored = latest.select(
        "application_id", F.concat(F.lit(CUSTOMER_HEADING), profile).alias("customer_block")
    )
    reasons = drivers.select(
        "application_id",
        F.concat(F.lit(DRIVER_HEADING), F.col("driver_text")).alias("driver_block"),
    )
    return scored.join(reasons, "application_id", "left")


def assessment_questions(applications: DataFrame, query: Column) -> DataFrame:
    """The standing question for a full assessment, one row per application."""
    key = F.col("application_id")
    return applications.select(
        key.alias("question_id"),
        F.format_string(ASSESSMENT_QUESTION, key).alias("question"),
        query.alias("query_id"),
        key,
    )


def prompt_rows(
    questions: DataFrame,
    contexts: DataFrame,
    applications: DataFrame,
    instructions: str = ANALYST_INSTRUCTIONS,
    query_id: str = "query_id",
) -> DataFrame:
    """One prompt per question: instructions, policy, customer, drivers, question.

    ``questions`` has question_id, question, ``query_id`` and an optional application_id;
    ``contexts`` one row per ``query_id`` and ``applications`` one row per application (see
    :func:`application_context`).  Pass both as written tables: a third of all questions may
    be about one application or one topic.  Missing parts are left out.
    """
    asked = questions.withColumn("application_id", F.upper("application_id"))
    joined = asked.join(applications, "application_id", "left").join(contexts, query_id, "left")
    prompt = F.concat_ws(
        "\n\n",
        F.lit(instructions),
        F.concat(F.lit(POLICY_HEADING), F.coalesce("policy_context", F.lit(""))),
        "customer_block",
        "driver_block",
        F.concat(F.lit(QUESTION_HEADING), F.col("question"), F.lit(QUESTION_CLOSING)),
    )
    return joined.select("question_id", "application_id", prompt.alias("prompt"))
