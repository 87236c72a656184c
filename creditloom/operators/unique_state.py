"""Uniqueness of a key over all landings, with work in proportion to the newest one.

Each landing leaves a bitmap of the hashes of its keys.  A key of a new landing can only stand in
an earlier one if its bit is set there, so only such keys (and those that repeat inside the landing)
are looked for in the earlier rows.  The check is exact: a bit that two keys share costs a look,
never a wrong result.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.session import write_stage
from creditloom.sources.snapshots import read_parts, replace_part

#: Bits of a bitmap; about eight times the keys of all landings leave few false looks.
BITS = 1 << 24


def _bit(key: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(bits))


def key_bitmaps(rows: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """``bucket`` and ``bitmap``: one row per 32,768 bits of which one is set."""
    bit = _bit(key, bits)
    return (
        rows.where(F.col(key).isNotNull())
        .groupBy(F.bitmap_bucket_number(bit).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bitmap"))
    )


def keep_bitmaps(
    rows: DataFrame, path: str, landed_on: dt.date, key: str, bits: int = BITS
) -> None:
    """Keep the bitmap of one landing; a repeated landing replaces its own."""
    replace_part(key_bitmaps(rows, key, bits), path, landed_on.isoformat())


def kept_bitmaps(
    spark: SparkSession, path: str, before: list[dt.date] | None = None
) -> DataFrame | None:
    """The bits of all landings, or of the named ones, put together; None if there are none."""
    if before is not None and not before:
        return None
    found = read_parts(spark, path, *[day.isoformat() for day in before or []])
    if found is None:
        return None
    return found.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def _is_set(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (position / 8).cast("int") + 1, F.lit(1))), 16, 10)
    return (byte.cast("int").bitwiseAND(F.pow(F.lit(2), position % 8).cast("int"))) > 0


def repeated_keys(
    new: DataFrame, earlier: DataFrame | None, bitmaps: DataFrame | None, key: str, bits: int = BITS
) -> tuple[DataFrame, DataFrame]:
    """Keys of a new landing that stand more than once in all landings, with their rows, and
    the keys that were looked for in ``earlier``, the rows before it."""
    own = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("own"))
    own = write_stage(own, "new-keys")
    if earlier is None or bitmaps is None:
        alone = own.where("own > 1").withColumnRenamed("own", "n")
        return alone, own.limit(0).select(key)
    bit = _bit(key, bits)
    marked = own.withColumns(
        {"bucket": F.bitmap_bucket_number(bit), "_position": F.bitmap_bit_position(bit)}
    )
    is_set = F.coalesce(_is_set(F.col("bitmap"), F.col("_position")), F.lit(False))
    asked = write_stage(
        marked.join(bitmaps, "bucket", "left")
        .withColumn("_asked", is_set)
        .where("_asked or own > 1")
        .select(key, "own", "_asked"),
        "looked-for",
    )
    looked_for = asked.where("_asked").select(key)
    before = earlier.select(key).join(looked_for, key, "left_semi")
    # counts of both sides are added up, which needs no order of either by key
    rows = asked.select(key, "own").unionByName(before.withColumn("own", F.lit(1).cast("bigint")))
    found = rows.groupBy(key).agg(F.sum("own").alias("n")).where("n > 1")
    return write_stage(found, "repeated"), looked_for


def failing_after(failing: DataFrame | None, found: DataFrame, key: str) -> DataFrame:
    """All repeated keys after a landing: what it found takes the place of what was known."""
    if failing is None:
        return found
    return failing.join(found.select(key), key, "left_anti").unionByName(found)
