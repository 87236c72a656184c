"""Keep-latest: deduplication and upsert.

``row_number() = 1`` is planned by Spark as a partial group limit in front of the shuffle
and a final one behind it, so each map task sends at most one row per key.  A key that holds
a third of all rows costs one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``; full-row hash settles remaining ties."""
    tie_break = F.xxhash64(*[_hashable(f) for f in df.schema.fields]).desc()
    window = W.partitionBy(*keys).orderBy(*order, tie_break)
    return (
        df.withColumn("_place", F.row_number().over(window))
        .where(F.col("_place") == 1)
        .drop("_place")
    )


def _hashable(field: T.StructField) -> Column:
    """Maps have no defined order and cannot be hashed; their sorted entries can."""
    value = F.col(field.name)
    is_map = isinstance(field.dataType, T.MapType)
    return F.array_sort(F.map_entries(value)) if is_map else value


def _once(df: DataFrame, keys: Sequence[str], rest: Sequence[str], name: str) -> DataFrame:
    """One struct of the other columns per key; a second row of a key fails the job."""
    rows = df.groupBy(*keys).agg(F.first(F.struct(*rest)).alias(name), F.count("*").alias("_n"))
    repeated = F.raise_error(F.concat(F.lit("repeated key "), F.to_json(F.struct(*keys))))
    return rows.select(*keys, F.when(F.col("_n") == 1, F.col(name)).otherwise(repeated).alias(name))


def upsert(
    target: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    update_columns: Sequence[str] | None = None,
    on_conflict: str = "update",
) -> DataFrame:
    """Rows of ``target`` merged with ``updates`` on unique ``keys``.

    ``on_conflict='update'`` replaces ``update_columns`` (all but the keys when not given) of
    an existing row; ``'ignore'`` keeps the existing row.  Both sides have at most one row per
    key, so a plain full outer join is enough and no key can be hot; a repeated key is an error
    (it is counted where the rows of a key meet for the join, so the check costs no shuffle).
    """
    if on_conflict not in ("update", "ignore"):
        raise ValueError(f"on_conflict must be 'update' or 'ignore', not {on_conflict!r}")
    rest = [c for c in target.columns if c not in keys]
    replaced = set(rest if update_columns is None else update_columns)
    if on_conflict == "ignore":
        replaced = set()
    old, new = _once(target, keys, rest, "_old"), _once(updates, keys, rest, "_new")
    joined = old.join(new, list(keys), "full")
    both = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    columns = []
    for c in rest:
        keep_old, take_new = F.col(f"_old.{c}"), F.col(f"_new.{c}")
        on_both = take_new if c in replaced else keep_old
        alone = F.when(F.col("_old").isNotNull(), keep_old).otherwise(take_new)
        columns.append(F.when(both, on_both).otherwise(alone).alias(c))
    return joined.select(*keys, *columns).select(*target.columns)
