"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import contextvars
import os
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import creditloom

# Functions that run inside tasks travel with the task, so executors need no installation.
cloudpickle.register_pickle_by_value(creditloom)

#: SQL settings every plan in this package assumes.  All are runtime settings, so they can
#: be applied to a session that somebody else created.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # keys and numbers shrink tenfold on the way: 64 MB of them are millions of rows in one task
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # split a hot partition even when a later join or aggregate then needs its own shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # rows of numbers; operators on whole texts ask for smaller batches
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(
    cores: int | str = "*", app_name: str = "creditloom", shared: str | None = None
) -> SparkSession:
    """A local session for tests and benchmarks; ``shared`` names the folder for stages."""
    n = os.cpu_count() if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.driver.memory", os.environ.get("CREDITLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors can read and write, named by ``spark.checkpoint.dir``.

    There is no other choice: a machine-local folder would be wrong on a cluster.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    return named.rstrip("/")


#: Folder of the stages of the run that is going on, inside the application's.
_RUN = contextvars.ContextVar("run", default="shared")


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; never reused, so readers are never overwritten."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/creditloom/{app}/{_RUN.get()}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def stages_of_run(spark: SparkSession) -> Iterator[None]:
    """Stages written inside the block are deleted at its end, also when it fails."""
    token = _RUN.set(f"run-{uuid.uuid4().hex[:12]}")
    try:
        yield
    finally:
        drop_stages(spark)
        _RUN.reset(token)


def write_stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Three things come from the write.  The lineage is cut, so a lost executor costs only the
    tasks it was running.  The table has a known size, so a join on it is broadcast only when
    that size is under the broadcast threshold.  And a join on it starts from its own
    exchange, which is the one shape adaptive execution can split when a key is hot (a join
    fed directly by an aggregate or window on the same key is never split).
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession) -> None:
    """Delete the intermediate tables of the current run, once nothing reads them."""
    app = spark.sparkContext.applicationId
    folder = f"{shared_folder(spark)}/creditloom/{app}/{_RUN.get()}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer tasks than cores one task per core before heavy per-row work.

    A table with at least as many scan tasks as cores is left alone, so a large table is
    never shuffled by this.  Pass a table scan: asking a plan with a shuffle for its number of
    tasks would run the shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def side_by_side(*steps: Callable) -> list:
    """Run independent driver steps at once, so that their jobs share the cluster."""
    with ThreadPoolExecutor(len(steps)) as pool:
        jobs = [pool.submit(contextvars.copy_context().run, step) for step in steps]
    return [job.result() for job in jobs]
