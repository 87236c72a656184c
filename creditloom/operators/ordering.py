"""Positions and running totals over a total order, without a single-partition window.

The rows are range-partitioned and sorted, so block ``i`` holds only rows that come before
those of block ``i + 1``.  The layout is written once to the shared folder (range bounds are
sampled, so two runs of the same plan could cut the blocks differently).  Numbers and sums
inside a block are made on the way to that write, while the rows pass in order, so the table is
shuffled once.  What a block needs
from the blocks before it is one small number per block; those numbers are added up on the
driver (one row per shuffle partition) and joined back as a broadcast.

A key that holds a third of all rows spans many blocks, because the range bounds are taken
over the whole sort key and not only over the group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.session import shuffle_partitions, write_stage


def _sorted_blocks(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    return df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(
        *order
    )


def with_position(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Add the 1-based place of every row in ``order`` (which must be a total order)."""
    # monotonically_increasing_id is (partition << 33) + row number inside the partition.
    laid_out = write_stage(
        _sorted_blocks(df, order).withColumn("_slot", F.monotonically_increasing_id()),
        "positions",
    )
    slotted = laid_out.withColumn("_block", F.shiftright("_slot", 33))
    sizes = slotted.groupBy("_block").count().orderBy("_block").collect()  # one row per block
    starts = [0, *accumulate(r["count"] for r in sizes)]
    offsets = _small(
        df, [(r["_block"], s) for r, s in zip(sizes, starts)], "_block bigint, _start bigint"
    )
    in_block = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        slotted.join(F.broadcast(offsets), "_block")
        .withColumn(name, F.col("_start") + in_block + 1)
        .drop("_block", "_start", "_slot")
    )


def with_running_sums(
    df: DataFrame, order: Sequence[Column], sums: dict[str, str]
) -> DataFrame:
    """Add inclusive running sums ``{new column: summed column}`` in ``order``.

    Callers aggregate to distinct sort keys first, so ``order`` is total and the moved rows
    are counts rather than raw rows.
    """
    blocks = _sorted_blocks(df, order).withColumn("_block", F.spark_partition_id())
    schema = T.StructType(
        [*blocks.schema.fields, *[T.StructField(f"_in_{new}", T.LongType()) for new in sums]]
    )
    laid_out = write_stage(blocks.mapInArrow(_cumulate(sums), schema), "running")
    totals = (
        laid_out.groupBy("_block")
        .agg(*[F.sum(c).alias(c) for c in sums.values()])
        .orderBy("_block")
        .collect()  # one row per block
    )
    starts = {
        new: [0, *accumulate(r[c] for r in totals)] for new, c in sums.items()
    }
    offsets = _small(
        df,
        [(r["_block"], *[starts[new][i] for new in sums]) for i, r in enumerate(totals)],
        "_block int, " + ", ".join(f"_start_{new} bigint" for new in sums),
    )
    out = laid_out.join(F.broadcast(offsets), "_block")
    placed = {new: F.col(f"_in_{new}") + F.coalesce(f"_start_{new}", F.lit(0)) for new in sums}
    return out.withColumns(placed).select(*df.columns, *sums)


def _cumulate(sums: dict[str, str]):
    """Append running sums of the rows of one block; nulls count as 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = dict.fromkeys(sums, 0)
        for batch in batches:
            columns, names = list(batch.columns), list(batch.schema.names)
            for new, c in sums.items():
                numbers = pc.cast(pc.fill_null(batch.column(c), 0), pa.int64())
                upto = pc.add(pc.cumulative_sum(numbers), carried[new])
                carried[new] = upto[-1].as_py() if len(upto) else carried[new]
                columns.append(upto)
                names.append(f"_in_{new}")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _number_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Append the 1-based place of each row in its run of equal ``_group``."""
    last, count = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column("_group").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        row = np.arange(len(group)) - np.repeat(first, np.diff([*first, len(group)])) + 1
        if group[0] == last:
            row[: first[1] if len(first) > 1 else len(row)] += count
        last, count = group[-1], int(row[-1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(row, pa.int64())], names=[*batch.schema.names, "_row"]
        )


def with_group_rank(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank"
) -> DataFrame:
    """Add the 1-based rank of every row inside its group; groups may be arbitrarily large.

    Only a group that crosses a block border needs to know about earlier blocks, and such a
    group is the first or the last of each block it touches: at most two per block.
    """
    keys = [F.col(g) for g in group]
    blocks = _sorted_blocks(df, [*keys, *order]).withColumns(
        # rows of a group stand together, so its hash tells it from its neighbours
        {"_block": F.spark_partition_id(), "_group": F.xxhash64(*keys)}
    )
    schema = T.StructType([*blocks.schema.fields, T.StructField("_row", T.LongType())])
    laid_out = write_stage(blocks.mapInArrow(_number_groups, schema), "group-ranks")
    borders = (
        laid_out.groupBy("_block")
        .agg(F.min(F.struct(*keys)).alias("lo"), F.max(F.struct(*keys)).alias("hi"))
        .select(F.explode(F.array("lo", "hi")).alias("g"))
        .select("g.*")
        .distinct()
    )
    pieces = (
        laid_out.join(F.broadcast(borders), list(group), "left_semi")
        .groupBy(*group, "_block")
        .count()
        .orderBy(*group, "_block")
        .collect()  # at most two rows per block
    )
    offsets, previous, running = [], None, 0
    for r in pieces:
        this = tuple(r[g] for g in group)
        running = running if this == previous else 0
        offsets.append((*this, r["_block"], running))
        previous, running = this, running + r["count"]
    fields = [df.schema[g] for g in group]
    schema = T.StructType(
        [*fields, T.StructField("_block", T.IntegerType()), T.StructField("_start", T.LongType())]
    )
    return (
        laid_out.join(F.broadcast(_small(df, offsets, schema)), [*group, "_block"], "left")
        .withColumn(name, F.col("_row") + F.coalesce("_start", F.lit(0)))
        .select(*df.columns, name)
    )


def _small(df: DataFrame, rows: list, schema) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)
