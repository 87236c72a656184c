"""Keyed tables in hash buckets: a merge rewrites the buckets of its keys and no others.

Each bucket is a part with its own pointers (see :mod:`snapshots`), so two merges that touch
different buckets do not meet, and of two that touch the same one the later one merges again.  A
merge is one job over the touched buckets, written in one go.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.operators.latest import upsert
from creditloom.session import write_stage
from creditloom.sources.snapshots import _current, _folder, _point, _pointers

BUCKETS = 64
_BUCKET = "_bucket"


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _part(bucket: int, buckets: int) -> str:
    return f"{bucket:05d}-of-{buckets:05d}"


def _found(spark: SparkSession, path: str, buckets: int | None) -> dict[str, list]:
    """Pointers of the table, which must have been written with as many buckets."""
    found = _pointers(spark, path)
    if buckets is not None and any(int(part.split("-of-")[1]) != buckets for part in found):
        raise ValueError(f"{path} does not have {buckets} buckets")
    return found


def read_keyed(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of a keyed table; None when nothing is written."""
    named = [_current(found) for found in _found(spark, path, None).values()]
    folders = [f"{path}/{name}" for name in named if name]
    return spark.read.parquet(*sorted(folders)) if folders else None


def merge_keyed(
    rows: DataFrame,
    path: str,
    keys: Sequence[str],
    update_columns: Sequence[str] | None = None,
    on_conflict: str = "update",
    buckets: int = BUCKETS,
    attempts: int = 5,
) -> list[int]:
    """Upsert ``rows`` (one per key) into a keyed table; the buckets that were rewritten."""
    spark = rows.sparkSession
    dealt = write_stage(rows.withColumn(_BUCKET, bucket_of(keys, buckets)), "merge")
    touched = sorted(r[0] for r in dealt.select(_BUCKET).distinct().collect())  # at most ``buckets``
    left = touched
    for _ in range(attempts):
        if not left:
            return touched
        found = _found(spark, path, buckets)
        before = {b: found.get(_part(b, buckets), []) for b in left}
        folders = [f"{path}/{name}" for b in left if (name := _current(before[b]))]
        new = dealt.where(F.col(_BUCKET).isin(left)).drop(_BUCKET)
        old = spark.read.parquet(*folders).select(*new.columns) if folders else new.limit(0)
        merged = upsert(old, new, keys, update_columns, on_conflict)
        folder = f"merge-{uuid.uuid4().hex}"
        merged.withColumn(_BUCKET, bucket_of(keys, buckets)).write.partitionBy(_BUCKET).parquet(
            f"{path}/{folder}"
        )
        late = []
        for b in left:
            number = before[b][-1][0] + 1 if before[b] else 1
            own = f"{folder}/{_BUCKET}={b}"
            if _point(spark, path, _part(b, buckets), number, own):
                _drop_old(spark, path, _part(b, buckets))
            else:  # somebody else has written this bucket meanwhile
                fs, where = _folder(spark, f"{path}/{own}")
                fs.delete(where, True)
                late.append(b)
        left = late
    if left:
        raise RuntimeError(f"buckets {left} of {path} were changed by others {attempts} times")
    return touched


def _drop_old(spark: SparkSession, path: str, part: str) -> None:
    """The two newest states of a bucket are kept: a reader may still be at the one before."""
    found = [(n, s) for n, s in _pointers(spark, path).get(part, []) if s]
    for number, snapshot in found[:-2]:
        fs, pointer = _folder(spark, f"{path}/_current/{number:012d}@{part}")
        fs.delete(pointer, False)
        fs.delete(_folder(spark, f"{path}/{snapshot}")[1], True)
