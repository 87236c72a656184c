"""Running products of a monoid inside groups of any size, over sorted blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.llm.common import stage
from creditloom.session import shuffle_partitions

#: An element of the monoid, as numbers that fit 64 bits.
Element = tuple[int, ...]


def running_products(
    df: DataFrame,
    group: str,
    order: list[str],
    of: list[str],
    into: list[str],
    element: Callable[..., Element],
    combine: Callable[[Element, Element], Element],
    name: str,
) -> DataFrame:
    """``df`` with the product of ``element(*of)`` up to and including each row of its group.

    ``combine`` must be associative; ``into`` names the numbers of the result.  Rows are sorted
    by group and order into blocks by range, so a group of any size spans many tasks.  Products are
    made inside the blocks first; only the first group of a block can have begun before, and it
    needs one element from there.  These elements (at most two groups a block) are put together
    on the driver.  Nulls in ``order`` come first; rows that are equal in it may stand in any order.
    """
    spark = df.sparkSession
    numbers = [T.StructField(x, T.LongType()) for x in into]
    marks = [
        T.StructField("_block", T.IntegerType()),
        T.StructField("_opens", T.BooleanType()),  # in the first group of the block
        T.StructField("_edge", T.BooleanType()),  # last row of the first or last group
    ]
    fields, own = df.schema.fields, df.columns
    schema = T.StructType([*fields, *numbers, *marks])
    places = [df.columns.index(c) for c in of]
    at_group = df.columns.index(group)

    def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total, current, opens, held = TaskContext.get().partitionId(), None, None, True, None

        for batch in batches:
            if not batch.num_rows:
                continue
            products, edges, openings = [], [], []
            columns = [c.to_pylist() for c in (batch.column(i) for i in (at_group, *places))]
            if held is not None:  # the row before this batch: was it the last of its group?
                yield _marked(*held, columns[0][:1] != [current] and opens)
            for n, (key, *values) in enumerate(zip(*columns)):
                if total is not None and key == current:
                    total = combine(total, element(*values))
                else:
                    if n and opens:
                        edges[-1] = True
                    opens, current, total = total is None, key, element(*values)
                products.append(total)
                openings.append(opens)
                edges.append(False)
            held = (batch, products, openings, edges, block)
        if held is not None:
            yield _marked(*held, True)

    def _marked(batch, products, openings, edges, block, last):
        edges[-1] = edges[-1] or last
        return pa.RecordBatch.from_arrays(
            [
                *batch.columns,
                *(pa.array(x, pa.int64()) for x in zip(*products)),
                pa.array([block] * len(products), pa.int32()),
                pa.array(openings),
                pa.array(edges),
            ],
            names=schema.names,
        )

    blocks = df.repartitionByRange(shuffle_partitions(spark), group, *order).sortWithinPartitions(
        group, *order
    )
    laid = stage(blocks.mapInArrow(in_blocks, schema), name)
    edges = (
        laid.where("_edge").select("_block", "_opens", group, *into).orderBy("_block", F.desc("_opens"))
    ).collect()  # at most two rows a block
    brought: dict[int, Element] = {}
    key, total = None, None
    for block, rows in groupby(edges, key=itemgetter(0)):
        for _, opens, this, *product in rows:
            product = tuple(product)
            if opens and total is not None and this == key:
                brought[block] = total
                product = combine(total, product)
            key, total = this, product

    def over_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if brought:
                late = [o and b in brought for o, b in zip(*(batch.column(x).to_pylist() for x in ("_opens", "_block")))]
                if any(late):
                    block = batch.column("_block").to_pylist()
                    products = zip(*(batch.column(x).to_pylist() for x in into))
                    new = [combine(brought[b], p) if y else p for y, b, p in zip(late, block, products)]
                    columns = dict(zip(batch.schema.names, batch.columns))
                    columns |= {x: pa.array(c, pa.int64()) for x, c in zip(into, zip(*new))}
                    batch = pa.RecordBatch.from_pydict(columns)
            yield batch.select([*own, *into])

    if not brought:
        return laid.select(*own, *into)
    return laid.mapInArrow(over_blocks, T.StructType([*fields, *numbers]))
