"""Exact nearest vectors through cells: an index table, and questions as a table beside it.

The vectors are cut into cells around centres that are fitted on a bounded sample; every vector
is in the index.  Each cell knows its radius (the widest angle to its centre), so by the triangle
inequality of angles no vector of a cell is nearer to a question than the angle to its centre
less the radius.  A question first visits the nearest cells that hold enough vectors; its k-th
distance there proves most of the other cells away, and the rest are visited in a second step.
Both steps are joins on the cell.  Cells of many vectors, and cells that many questions visit,
are dealt to several tasks as blocks, whose products are matrix products.

How much is proven away depends on the data: vectors without any grouping keep nearly all pairs.
The result is exact either way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from creditloom.session import spread, write_stage

#: Vectors that the centres are fitted on (in one task), and how often they are moved.
SAMPLE = 16_384
FIT_ROUNDS = 6
MAX_CELLS = 1024
#: Vectors and questions of a cell that one task multiplies at once.
BLOCK_VECTORS = 8192
BLOCK_QUERIES = 2048
#: A first visit takes in cells until they hold this many times k vectors.
FIRST_VISIT = 4
#: Distances are compared at this many decimals; equal ones are ordered by vector id.
DISTANCE_DIGITS = 6
#: More than rounding and the error of a product of unit vectors.
MARGIN = 2e-6
#: Cell of the vectors without a direction; they are at distance 1 from everything.
NO_DIRECTION = -1


def unit_rows(column: pa.Array) -> np.ndarray:
    """The vectors of a list column at length one; a vector of zeros stays as it is."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(n, -1) if n else flat.reshape(0, 1)
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(length > 0, length, 1.0)


@dataclass(frozen=True)
class VectorIndex:
    """``rows`` has cell, vector_id and vector; ``cells`` has cell, centre, radius and n."""

    rows: DataFrame
    cells: DataFrame


def _fitter(n_cells: int):
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("_key").to_numpy(), unit_rows(b.column("vector"))) for b in batches if b.num_rows]
        if not parts:
            return
        key, rows = (np.concatenate(x) for x in zip(*parts))
        rows = rows[np.argsort(key, kind="stable")]
        rows = rows[rows.any(axis=1)]
        centres = np.unique(rows[: 4 * n_cells], axis=0)
        centres = centres[np.random.default_rng(7).permutation(len(centres))[:n_cells]]
        for _ in range(FIT_ROUNDS if len(centres) else 0):
            own = np.argmax(rows @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, rows)
            length = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(length > 1e-9, sums / np.where(length > 1e-9, length, 1.0), centres)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(centres)), pa.int32()), pa.array(list(centres), pa.list_(pa.float64()))],
            names=["cell", "centre"],
        )

    return fit


def _assigner(centres: np.ndarray):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = unit_rows(batch.column("vector"))
            cell = np.full(len(rows), NO_DIRECTION, np.int32)
            angle = np.zeros(len(rows))
            if len(centres) and len(rows):
                cosine = rows @ centres.T
                directed = rows.any(axis=1)
                cell[directed] = np.argmax(cosine, axis=1)[directed]
                angle[directed] = np.arccos(np.clip(cosine.max(axis=1), -1, 1))[directed]
            columns = [pa.array(cell), pa.array(angle), *batch.columns]
            yield pa.RecordBatch.from_arrays(columns, names=["cell", "angle", *batch.schema.names])

    return assign


def build_index(
    vectors: DataFrame, vector_id: str = "vec_id", embedding: str = "embedding", n_cells: int | None = None
) -> VectorIndex:
    """Index of all vectors that are not null; written to stages, so it serves many searches."""
    named = vectors.where(F.col(embedding).isNotNull()).select(
        F.col(vector_id).alias("vector_id"), F.col(embedding).alias("vector")
    )
    if n_cells is None:
        n_cells = max(1, min(MAX_CELLS, isqrt(named.count())))
    sample = (
        named.select(F.xxhash64("vector_id").alias("_key"), "vector")
        .orderBy("_key")
        .limit(SAMPLE)
        .repartition(1)
    )
    fitted = write_stage(
        sample.mapInArrow(_fitter(n_cells), "cell int, centre array<double>"), "centres"
    )
    rows_of_centres = fitted.orderBy("cell").collect()  # at most MAX_CELLS
    centres = np.array([r["centre"] for r in rows_of_centres]) if rows_of_centres else np.empty((0, 1))
    schema = T.StructType(
        [
            T.StructField("cell", T.IntegerType()),
            T.StructField("angle", T.DoubleType()),
            *named.schema.fields,
        ]
    )
    rows = write_stage(spread(named).mapInArrow(_assigner(centres), schema), "vector-index")
    sizes = rows.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
    return VectorIndex(rows, write_stage(sizes.join(fitted, "cell", "left"), "vector-cells"))


def _visits(cells: list, k: int, second: bool):
    """Task function: the cells that each question visits in the first or in the second step."""
    number = np.array([c["cell"] for c in cells], np.int32)
    size = np.array([c["n"] for c in cells])
    radius = np.array([c["radius"] for c in cells])
    known = next((len(c["centre"]) for c in cells if c["centre"] is not None), 1)
    centres = np.array([c["centre"] or [0.0] * known for c in cells]).reshape(len(cells), known)
    nowhere = number == NO_DIRECTION

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(cells):
                continue
            rows = unit_rows(batch.column("vector"))
            angle = np.arccos(np.clip(rows @ centres.T, -1, 1))
            angle[:, nowhere] = np.pi / 2
            order = np.argsort(angle, axis=1, kind="stable")
            before = np.cumsum(size[order], axis=1) - size[order]
            first = np.zeros(angle.shape, bool)
            np.put_along_axis(first, order, before < FIRST_VISIT * k, axis=1)
            if second:
                least = 1.0 - np.cos(np.maximum(angle - radius, 0.0))
                least[:, nowhere] = 1.0
                least[~rows.any(axis=1)] = 0.0  # all angles are made up
                bound = batch.column("bound").to_numpy(zero_copy_only=False)
                wanted = ~first & ((least <= bound[:, None] + MARGIN) | np.isnan(bound)[:, None])
            else:
                wanted = first
            query, cell = np.nonzero(wanted)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("query_id").take(pa.array(query)),
                    batch.column("vector").take(pa.array(query)),
                    pa.array(number[cell]),
                ],
                names=["query_id", "vector", "cell"],
            )

    return run


def _block_product(k: int, schema: pa.Schema):
    """The k nearest of a block of vectors for each question of a block."""

    def nearest(questions: pa.Table, vectors: pa.Table) -> pa.Table:
        if not questions.num_rows or not vectors.num_rows:
            return schema.empty_table()
        ids = vectors.column("vector_id").combine_chunks()
        by_id = np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        q, v = (unit_rows(t.column("vector").combine_chunks()) for t in (questions, vectors))
        distance = 1.0 - q @ v.T
        # one whole number per cell: rounded distance, then place by id
        key = np.rint(distance * 10**DISTANCE_DIGITS).astype(np.int64) * len(by_id) + by_id
        keep = min(k, len(by_id))
        top = np.argpartition(key, keep - 1, axis=1)[:, :keep]
        at = np.repeat(np.arange(len(q)), keep)
        return pa.table(
            [
                questions.column("query_id").combine_chunks().take(pa.array(at)),
                ids.take(pa.array(top.ravel())),
                pa.array(np.take_along_axis(distance, top, axis=1).ravel()),
            ],
            schema=schema,
        )

    return nearest


def _visit(
    index: VectorIndex, pairs: DataFrame, k: int, schema: T.StructType, block_queries: int
) -> DataFrame:
    """Compare the questions with the vectors of the cells they visit, block by block."""
    blocks = (
        pairs.groupBy("cell")
        .agg(F.count("*").alias("asked"))
        .join(index.cells.select("cell", "n"), "cell")
        .select(
            "cell",
            F.ceil(F.col("n") / BLOCK_VECTORS).cast("int").alias("by_vector"),
            F.ceil(F.col("asked") / block_queries).cast("int").alias("by_query"),
        )
    )  # one row per cell
    blocks = F.broadcast(write_stage(blocks, "blocks"))

    def parts(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def dealt(key: str, n: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    keys = ["cell", "v", "q"]
    asked = pairs.join(blocks, "cell").withColumn("q", dealt("query_id", "by_query"))
    asked = asked.withColumn("v", parts("by_vector")).select(*keys, "query_id", "vector")
    held = index.rows.join(blocks, "cell").withColumn("v", dealt("vector_id", "by_vector"))
    held = held.withColumn("q", parts("by_query")).select(*keys, "vector_id", "vector")
    product = _block_product(k, to_arrow_schema(schema))
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(product, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = W.partitionBy("query_id").orderBy(F.round("distance", DISTANCE_DIGITS), "vector_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def search(
    index: VectorIndex,
    queries: DataFrame,
    k: int,
    query_id: str = "query_id",
    embedding: str = "embedding",
    block_queries: int = BLOCK_QUERIES,
) -> tuple[DataFrame, DataFrame]:
    """Hits (query_id, rank, vector_id, distance), and how many vectors each question was compared
    with (query_id, cells, compared).  Questions without a vector have no hits."""
    asked = write_stage(
        queries.where(F.col(embedding).isNotNull()).select(
            F.col(query_id).alias("query_id"), F.col(embedding).alias("vector")
        ),
        "questions",
    )
    cells = index.cells.orderBy("cell").collect()  # at most MAX_CELLS and one
    pair = T.StructType([*asked.schema.fields, T.StructField("cell", T.IntegerType())])
    found = T.StructType(
        [
            asked.schema["query_id"],
            index.rows.schema["vector_id"],
            T.StructField("distance", T.DoubleType()),
        ]
    )
    first = write_stage(asked.mapInArrow(_visits(cells, k, False), pair), "first-visits")
    near = write_stage(_ranked(_visit(index, first, k, found, block_queries), k), "first-hits")
    bounds = near.where(F.col("rank") == k).select("query_id", F.col("distance").alias("bound"))
    bounded = asked.join(bounds, "query_id", "left")
    second = write_stage(bounded.mapInArrow(_visits(cells, k, True), pair), "second-visits")
    more = _visit(index, second, k, found, block_queries)
    hits = _ranked(near.drop("rank").unionByName(more), k)
    sizes = index.cells.select("cell", "n")
    compared = (
        first.unionByName(second)
        .select("query_id", "cell")
        .join(F.broadcast(sizes), "cell")
        .groupBy("query_id")
        .agg(F.count("*").alias("cells"), F.sum("n").alias("compared"))
    )
    return hits.select("query_id", "rank", "vector_id", "distance"), compared
