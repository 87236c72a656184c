"""Text and table helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.session import write_stage

#: The characters that separate words, as Java regular expressions.
WHITE_SPACE = r"[\x20\x09-\x0D]+"
NOT_ALNUM_ASCII = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it in a lambda.

    A lambda that mentions an outer expression computes it again for each element, so an
    array that is indexed inside a lambda must be bound to a name first.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column, separators: str) -> Column:
    """Maximal runs of characters outside ``separators``; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is.

    ``lower`` does the same on texts of ASCII characters alone and is much faster.
    """
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def positions(n: Column) -> Column:
    """0, 1, ... n - 1; empty where n is not positive."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(
        F.array().cast("array<int>")
    )


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than that many."""
    return df.limit(rows + 1).count() <= rows


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is.

    Past the bound the join is a shuffled one, which adaptive execution splits at hot keys.
    """
    return F.broadcast(df) if small_enough(df, rows) else df


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores behind it until no column is called so."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name += "_"
    return name


def join_rows(
    docs: DataFrame, found: DataFrame, id_col: str, text_col: str, how: str
) -> DataFrame:
    """``docs`` joined with ``found`` on id and text; null ids match null ids.

    ``found`` has ``doc_id``, ``t`` (xxhash64 of the text) and at most a third column, whose name
    must be free in ``docs``.  Columns of ``docs`` may be called anything.
    """
    d, t = free_name(docs.columns, "_doc_id"), free_name(docs.columns, "_text_hash")
    keys = found.withColumnsRenamed({"doc_id": d, "t": t})
    same = column(id_col).eqNullSafe(F.col(d)) & (F.xxhash64(column(text_col)) == F.col(t))
    return docs.join(keys, same, how)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again, so that no later loss repeats the work."""
    return write_stage(df, f"llm-{name}")


def arrow_rows(spark: SparkSession, rows: int = 256) -> None:
    """Keep Arrow batches small: a batch holds whole texts, and a text can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
