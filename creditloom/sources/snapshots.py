"""Tables that are replaced as a whole: a new folder, then a pointer to it.

A table is a set of parts, each with a folder of snapshots.  Replacing a part writes a new
snapshot and then creates one small pointer file: its name is a running number and the part, its
content the snapshot.  Readers take the pointer of the largest number, so until the pointer
exists they read the snapshot before, whatever becomes of the writer.  A number can be taken only
once, so a writer that started from rows that were replaced meanwhile notices it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

POINTERS = "_current"
WHOLE = "all"


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _pointers(spark: SparkSession, path: str) -> dict[str, list[tuple[int, str | None]]]:
    """Per part the running numbers and snapshots, oldest first; a few small files.

    The snapshot is None where a writer has taken a number but not said yet what it wrote.
    """
    fs, folder = _folder(spark, f"{path}/{POINTERS}")
    out: dict[str, list[tuple[int, str | None]]] = {}
    if fs.exists(folder):
        for status in fs.listStatus(folder):
            number, part = status.getPath().getName().split("@")
            stream = fs.open(status.getPath())
            text = bytes(b & 0xFF for b in stream.readAllBytes()).decode()
            stream.close()
            out.setdefault(part, []).append((int(number), text or None))
    return {part: sorted(found, key=lambda x: x[0]) for part, found in out.items()}


def _current(found: list[tuple[int, str | None]]) -> str | None:
    return next((snapshot for _, snapshot in reversed(found) if snapshot), None)


def _point(spark: SparkSession, path: str, part: str, number: int, snapshot: str) -> bool:
    """Take a number for a snapshot; False if another writer has it."""
    fs, pointer = _folder(spark, f"{path}/{POINTERS}/{number:012d}@{part}")
    try:
        stream = fs.create(pointer, False)
    except Py4JJavaError as e:
        if fs.exists(pointer):
            return False
        raise e
    stream.write(bytearray(snapshot.encode()))
    stream.close()
    return True


def _write_snapshot(df: DataFrame, path: str, part: str) -> str:
    if "@" in part or "/" in part:
        raise ValueError(f"a part cannot be called {part!r}")
    snapshot = f"snapshot-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{path}/{part}/{snapshot}")
    return snapshot


def _drop_old(spark: SparkSession, path: str, part: str) -> None:
    """The two newest snapshots of a part are kept: a reader may still be at the one before."""
    found = [(n, s) for n, s in _pointers(spark, path).get(part, []) if s]
    for number, snapshot in found[:-2]:
        fs, pointer = _folder(spark, f"{path}/{POINTERS}/{number:012d}@{part}")
        fs.delete(pointer, False)
        fs.delete(_folder(spark, f"{path}/{part}/{snapshot}")[1], True)


def replace_part(df: DataFrame, path: str, part: str = WHOLE) -> None:
    """Write ``df`` as the rows of a part, whatever is there; of two writers the later one stays.

    A writer whose rows come from the rows that are there must use :func:`update_part`.
    """
    spark = df.sparkSession
    snapshot = _write_snapshot(df, path, part)
    while True:
        before = _pointers(spark, path).get(part, [])
        if _point(spark, path, part, before[-1][0] + 1 if before else 1, snapshot):
            break
    _drop_old(spark, path, part)


def update_part(
    spark: SparkSession,
    path: str,
    change: Callable[[DataFrame | None], DataFrame],
    part: str = WHOLE,
    attempts: int = 5,
) -> None:
    """Replace a part by ``change`` of its rows (None when nothing is written).

    If another writer was faster, ``change`` is made again on what that one wrote, so no update
    is lost; after ``attempts`` it is an error.
    """
    for _ in range(attempts):
        before = _pointers(spark, path).get(part, [])
        current = _current(before)
        old = spark.read.parquet(f"{path}/{part}/{current}") if current else None
        snapshot = _write_snapshot(change(old), path, part)
        if _point(spark, path, part, before[-1][0] + 1 if before else 1, snapshot):
            _drop_old(spark, path, part)
            return
        fs, folder = _folder(spark, f"{path}/{part}/{snapshot}")
        fs.delete(folder, True)
    raise RuntimeError(f"part {part!r} of {path} was changed by others {attempts} times")


def read_parts(spark: SparkSession, path: str, *parts: str) -> DataFrame | None:
    """The current rows of all parts, or of the named ones; None when nothing is written."""
    current = {part: _current(found) for part, found in sorted(_pointers(spark, path).items())}
    named = [f"{path}/{p}/{s}" for p, s in current.items() if s and (not parts or p in parts)]
    return spark.read.parquet(*named) if named else None


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A table of the lake, in snapshots or plain; None when it has not been written yet."""
    found = read_parts(spark, path)
    if found is not None:
        return found
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def known_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of the lake that must exist."""
    found = read_table(spark, path)
    if found is None:
        raise LookupError(f"no table in {path}")
    return found
