"""What was landed: row counts and fingerprints, run log, schema history and schema drift."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.functions.text import short_hash
from creditloom.operators.latest import latest_per_key

AUDIT_SCHEMA = (
    "run_id string, source_name string, execution_date date, row_count bigint, "
    "file_size_bytes bigint, column_names array<string>, column_dtypes map<string,string>, "
    "row_hash string, status string, error_message string, parquet_path string, "
    "ingested_at timestamp"
)
# Rank of a status when two events of a run carry the same time.
STATUS_ORDER = ["running", "failed", "success"]


def profile_ingest(df: DataFrame, source: str) -> DataFrame:
    """One row: row count, columns, types and fingerprint of a landed table.

    The fingerprint hashes the sorted column names and the row count.
    """
    names = df.columns
    dtypes = [F.lit(x) for name, kind in df.dtypes for x in (name, kind)]
    listed = F.lit(f"{sorted(names)}|")
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(source).alias("source_name"),
        "row_count",
        F.array(*[F.lit(c) for c in names]).alias("column_names"),
        F.create_map(*dtypes).alias("column_dtypes"),
        short_hash(F.concat(listed, F.col("row_count").cast("string"))).alias("row_hash"),
    )


def file_bytes(files: DataFrame) -> DataFrame:
    """One row: total size of the files behind a file scan; each file counts once."""
    each = files.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")
    ).distinct()
    return each.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("file_size_bytes"))


def audit_event(
    spark: SparkSession,
    run_id: str,
    source: str,
    execution_date: dt.date,
    status: str,
    at: dt.datetime | None = None,
    **details,
) -> DataFrame:
    """One run-log row; ``details`` fill the optional columns."""
    fields = T.StructType.fromDDL(AUDIT_SCHEMA).fields
    row = dict.fromkeys([f.name for f in fields]) | details
    row |= {"run_id": run_id, "source_name": source, "execution_date": execution_date}
    row |= {"status": status, "ingested_at": at or dt.datetime.now()}
    return spark.range(1, numPartitions=1).select(
        *[_literal(row[f.name]).cast(f.dataType).alias(f.name) for f in fields]
    )


def _literal(value) -> Column:
    if isinstance(value, dict):
        return F.create_map(*[F.lit(x) for pair in value.items() for x in pair])
    return F.lit(value)


def append_audit(event: DataFrame, path: str, source: str) -> None:
    """The log is append-only; the current state of a run is :func:`latest_audit`.

    Each source has its own folder, so sources that land side by side do not share a
    commit directory.
    """
    rows = event.drop("source_name")
    rows.write.mode("append").parquet(f"{path}/source_name={source}")


def latest_audit(events: DataFrame) -> DataFrame:
    """Newest event per run and source."""
    place = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col("status"))
    return latest_per_key(
        events, ["run_id", "source_name"], [F.col("ingested_at").desc(), place.desc()]
    )


# Number formats and the names of the three inferred types.
INTEGER_PATTERN = r"^[+-]?\d+$"
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
TYPE_INTEGER, TYPE_FLOAT, TYPE_TEXT = "int64", "float64", "object"


def schema_snapshot(
    df: DataFrame, source: str, snapshot_date: Column, columns: Sequence[str] | None = None
) -> DataFrame:
    """Inferred type of every column per snapshot date; one aggregate over the rows.

    A column is an integer column when every value is a whole number and none is missing,
    else a float column when every present value is a number, else text.  Only text columns are
    matched value by value; of typed ones the missing values decide.  Returns (source_name,
    snapshot_date, column_names, column_dtypes, schema_hash).
    """
    columns = list(columns or df.columns)
    total, counts = F.count(F.lit(1)).alias("_n"), []
    for c in columns:
        kind = df.schema[c].dataType
        present, none = F.count(F.col(c)), F.count_if(F.lit(False))
        if isinstance(kind, T.StringType):
            text = F.trim(F.col(c))
            whole = F.count_if(F.regexp_like(text, F.lit(INTEGER_PATTERN)))
            number = F.count_if(F.regexp_like(text, F.lit(NUMBER_PATTERN)))
        else:
            whole = present if isinstance(kind, T.IntegralType) else none
            number = present if isinstance(kind, T.NumericType) else none
        counts += [
            present.alias(f"_{c}_present"),
            whole.alias(f"_{c}_whole"),
            number.alias(f"_{c}_number"),
        ]
    seen = df.groupBy(snapshot_date.cast("date").alias("snapshot_date")).agg(total, *counts)

    def dtype(c: str) -> Column:
        present, whole, number = (F.col(f"_{c}_{k}") for k in ("present", "whole", "number"))
        return (
            F.when((whole == F.col("_n")) & (present == F.col("_n")), TYPE_INTEGER)
            .when(number == present, TYPE_FLOAT)
            .otherwise(TYPE_TEXT)
        )

    pairs = [x for c in sorted(columns) for x in (F.lit(c), dtype(c))]
    typed = seen.select(
        F.lit(source).alias("source_name"),
        "snapshot_date",
        F.array(*[F.lit(c) for c in columns]).alias("column_names"),
        F.create_map(*pairs).alias("column_dtypes"),
    )
    return typed.withColumn("schema_hash", short_hash(schema_json(F.col("column_dtypes"))))


def write_snapshot(snapshot: DataFrame, path: str, source: str, day: dt.date) -> None:
    """Keep one snapshot per source and day: a repeated run overwrites its own folder."""
    folder = f"{path}/source_name={source}/snapshot_date={day}"
    rows = snapshot.drop("source_name", "snapshot_date").coalesce(1)
    rows.write.mode("overwrite").parquet(folder)


def schema_json(dtypes: Column) -> Column:
    """The type map as JSON text, keys in the order of the map."""
    entries = F.transform(
        F.map_entries(dtypes),
        lambda e: F.concat(F.lit('"'), e["key"], F.lit('": "'), e["value"], F.lit('"')),
    )
    return F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))


def schema_drift(snapshots: DataFrame) -> DataFrame:
    """Each snapshot compared with the one before it: changed, added, removed, retyped.

    Snapshots are one small row per source and day.
    """
    before = W.partitionBy("source_name").orderBy("snapshot_date")
    was = F.lag("column_dtypes").over(before)
    compared = snapshots.withColumns(
        {"previous_hash": F.lag("schema_hash").over(before), "_was": was}
    )
    now_keys = F.map_keys("column_dtypes")
    old_keys = F.coalesce(F.map_keys("_was"), now_keys)
    retyped = F.filter(
        F.array_intersect(now_keys, old_keys),
        lambda c: F.element_at("column_dtypes", c) != F.coalesce(
            F.element_at("_was", c), F.element_at("column_dtypes", c)
        ),
    )
    changed = F.col("previous_hash").isNotNull() & (F.col("previous_hash") != F.col("schema_hash"))
    return compared.select(
        "source_name",
        "snapshot_date",
        "schema_hash",
        "previous_hash",
        changed.alias("changed"),
        F.array_sort(F.array_except(now_keys, old_keys)).alias("added"),
        F.array_sort(F.array_except(old_keys, now_keys)).alias("removed"),
        F.array_sort(retyped).alias("retyped"),
    )
