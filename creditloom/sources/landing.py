"""Landing: source files to date-partitioned bronze Parquet, unchanged apart from metadata."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The source files and their columns.  Dates land as dates, so that a date range
# reaches the Parquet statistics of a landed table.
SOURCES = {
    "loan_applications": "loan_applications.csv",
    "credit_bureau": "credit_bureau.csv",
    "transactions": "transactions.csv",
    "macro_indicators": "macro_indicators.csv",
}
SOURCE_COLUMNS = {
    "loan_applications": (
        "application_id string, customer_id string, application_date date, "
        "loan_amount_inr bigint, loan_term_months bigint, annual_income_inr bigint, "
        "employment_type string, loan_purpose string, existing_loans bigint, "
        "credit_score bigint, collateral_value bigint, default_flag bigint"
    ),
    "credit_bureau": (
        "customer_id string, bureau_pull_date date, credit_score bigint, "
        "total_accounts bigint, open_accounts bigint, delinquent_accounts bigint, "
        "credit_utilisation_pct double, oldest_account_months bigint, hard_inquiries_6m bigint, "
        "total_credit_limit_inr bigint, total_balance_inr bigint"
    ),
    "transactions": (
        "transaction_id string, customer_id string, transaction_date date, amount_inr bigint, "
        "transaction_type string, channel string, merchant_code string, "
        "balance_after_inr bigint, is_flagged bigint"
    ),
    "macro_indicators": (
        "date date, rbi_repo_rate_pct double, cpi_inflation_pct double, "
        "gdp_growth_rate_pct double, unemployment_rate_pct double, usd_inr_exchange double, "
        "nifty_50_index bigint"
    ),
}
PARTITION_COLUMNS = ["year", "month", "day"]

FULL_EXTRACT, INCREMENT = "full extract", "increment"
#: What a file of a source holds: all rows there are, or those that are new.
LANDING = dict.fromkeys(SOURCES, FULL_EXTRACT)


def source_schema(spark: SparkSession, name: str, path: str) -> T.StructType:
    """Columns as the file header has them: known ones typed, new ones as text."""
    header = spark.read.option("header", True).csv(path).columns
    known = {f.name: f.dataType for f in T.StructType.fromDDL(SOURCE_COLUMNS[name]).fields}
    return T.StructType([T.StructField(c, known.get(c, T.StringType())) for c in header])


def read_source(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Scan a CSV source; a missing file, a malformed value and part files whose headers differ
    are errors."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    reader = reader.option("enforceSchema", False)
    return reader.schema(source_schema(spark, name, path)).csv(path)


def with_ingest_metadata(
    df: DataFrame,
    execution_date: dt.date | Column,
    ingested_at: dt.datetime | None = None,
    source_file: str | None = None,
) -> DataFrame:
    """Add when, from which file and for which run date a row was landed."""
    date = execution_date if isinstance(execution_date, Column) else F.lit(execution_date)
    stamp = F.current_timestamp() if ingested_at is None else F.lit(str(ingested_at))
    return df.withColumns(
        {
            "_bronze_ingested_at": stamp.cast("timestamp"),
            "_bronze_source_file": (
                F.col("_metadata.file_path") if source_file is None else F.lit(source_file)
            ),
            "_bronze_execution_date": date.cast("date").cast("string"),
        }
    )


def write_bronze(
    df: DataFrame, base: str, source: str, execution_date: dt.date | Column
) -> str:
    """Write the partition(s) of a run; a repeated run replaces exactly its own partitions.

    One run date needs no shuffle.  With a date per row the rows are rebalanced on the
    partition columns: small days share a task, a day with very many rows is split.
    """
    many = isinstance(execution_date, Column)
    date = (execution_date if many else F.lit(execution_date)).cast("date")
    parts = {"year": "yyyy", "month": "MM", "day": "dd"}
    out = df.withColumns({p: F.date_format(date, fmt) for p, fmt in parts.items()})
    if many:
        out = out.hint("rebalance", *[F.col(p) for p in PARTITION_COLUMNS])
    path = f"{base.rstrip('/')}/{source}"
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.option("compression", "snappy").partitionBy(*PARTITION_COLUMNS).parquet(path)
    return path


#: Types that hold all values of the ones before them; any other mixture is read as text.
WIDENING = [
    ["boolean", "string"],
    ["tinyint", "smallint", "int", "bigint", "double", "string"],
    ["float", "double", "string"],
    ["date", "timestamp", "string"],
    ["timestamp_ntz", "string"],
]


def widest(types: Iterable[str]) -> str:
    """The first type that holds the values of all of them."""
    types = set(types)
    if len(types) == 1:
        return types.pop()
    above = [next((o[o.index(t) :] for o in WIDENING if t in o), ["string"]) for t in types]
    return next(t for t in above[0] if all(t in a for a in above[1:]))


def _landed_days(spark: SparkSession, path: str) -> list[str]:
    """Folders of the days that were landed, oldest first; one entry per day."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/year=*/month=*/day=*")
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder)
    return sorted(str(status.getPath()) for status in found or [])


def _days_by_schema(spark: SparkSession, path: str) -> list[tuple[T.StructType, list[str]]]:
    """Days of the same columns and types together; one footer is read per day."""
    days = _landed_days(spark, path)
    with ThreadPoolExecutor(8) as pool:
        schemas = list(pool.map(lambda day: spark.read.parquet(day).schema, days))
    groups: dict[str, tuple[T.StructType, list[str]]] = {}
    for day, schema in zip(days, schemas):
        groups.setdefault(schema.simpleString(), (schema, []))[1].append(day)
    return list(groups.values())


def read_bronze(
    spark: SparkSession, base: str, source: str, day: dt.date | None = None
) -> DataFrame:
    """All landed rows of a source, or those of one run date.

    Days can have different columns and types.  A day is read from its own folder and has the
    columns that were landed on it.  The history has the columns of all days, null where a day had
    none; a column that changed its type is read as the first type that holds all its values.
    """
    path = f"{base.rstrip('/')}/{source}"
    if day is not None:
        return spark.read.parquet(f"{path}/{day:year=%Y/month=%m/day=%d}")
    try:
        return spark.read.option("mergeSchema", True).parquet(path).drop(*PARTITION_COLUMNS)
    except (Py4JJavaError, PySparkException) as e:
        if "CANNOT_MERGE" not in str(e):
            raise
    groups = _days_by_schema(spark, path)
    types: dict[str, list[str]] = {}
    for schema, _ in groups:
        for f in schema.fields:
            types.setdefault(f.name, []).append(f.dataType.simpleString())
    parts = [
        spark.read.schema(schema).parquet(*days).select(
            *[F.col(f"`{f.name}`").cast(widest(types[f.name])).alias(f.name) for f in schema.fields]
        )
        for schema, days in groups
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def landed_types(spark: SparkSession, base: str, source: str) -> DataFrame:
    """How each column was landed: column_name, type, days, first_day, last_day, read_as."""
    groups = _days_by_schema(spark, f"{base.rstrip('/')}/{source}")
    seen: dict[tuple[str, str], list[str]] = {}
    for schema, days in groups:
        stamps = ["-".join(x.split("=")[1] for x in d.split("/")[-3:]) for d in days]
        for f in schema.fields:
            seen.setdefault((f.name, f.dataType.simpleString()), []).extend(stamps)
    types: dict[str, list[str]] = {}
    for name, kind in seen:
        types.setdefault(name, []).append(kind)
    rows = [
        (name, kind, len(days), min(days), max(days), widest(types[name]))
        for (name, kind), days in seen.items()
    ]
    return spark.createDataFrame(
        rows,
        "column_name string, type string, days int, first_day string, last_day string, read_as string",
    )


def read_extract(spark: SparkSession, base: str, source: str, day: dt.date) -> DataFrame:
    """What a run of ``day`` works on: that day's extract, or everything landed so far.

    A full extract replaces the ones before it; counting both would count its rows twice.
    """
    return read_bronze(spark, base, source, day if LANDING[source] == FULL_EXTRACT else None)


def replace_table(df: DataFrame, name: str) -> None:
    """Drop and rewrite a catalog table from a DataFrame."""
    df.write.mode("overwrite").saveAsTable(name)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Text files of a folder, one row per file: source (file stem), filename, text."""
    files = spark.read.text(f"{folder.rstrip('/')}/*.txt", wholetext=True)
    name = F.col("_metadata.file_name")
    return files.select(
        F.regexp_replace(name, r"\.txt$", "").alias("source"),
        name.alias("filename"),
        F.col("value").alias("text"),
    )


def read_ids(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Ids of a batch request: the ``application_id`` column, whatever its case and spacing.

    All of them, unless ``limit`` asks for some.
    """
    rows = spark.read.option("header", True).csv(path)
    named = [c for c in rows.columns if c.strip("\ufeff \t").lower() == "application_id"]
    if not named:
        raise ValueError("the file has no application_id column")
    ids = rows.select(F.col(f"`{named[0]}`").alias("application_id"))
    ids = ids if limit is None else ids.limit(limit)
    if ids.isEmpty():
        raise ValueError("the file has no rows")
    return ids


def write_csv(df: DataFrame, path: str) -> None:
    """Write a result table as CSV with a header line per part file."""
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
