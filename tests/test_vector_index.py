import numpy as np
import pytest

from creditloom.operators import vector_index as vi


def table(spark, rows, name):
    return spark.createDataFrame(
        [(i, [float(x) for x in r]) for i, r in rows], f"{name} bigint, embedding array<float>"
    ).repartition(5)


def brute(queries, vectors, k):
    def unit(m):
        m = m.astype(np.float32).astype(np.float64)
        length = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(length > 0, length, 1)

    d = np.round(1 - unit(queries) @ unit(vectors).T, 6)
    return {i: sorted(range(len(vectors)), key=lambda j: (row[j], j))[:k] for i, row in enumerate(d)}


def run(spark, queries, vectors, k, block_queries=vi.BLOCK_QUERIES, **kw):
    index = vi.build_index(table(spark, enumerate(vectors), "vec_id"), **kw)
    hits, compared = vi.search(
        index, table(spark, enumerate(queries), "query_id"), k, block_queries=block_queries
    )
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vector_id)
    return got, {r.query_id: r.compared for r in compared.collect()}, index


def test_grouped_vectors_need_few_comparisons(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 24))
    vectors = centres[rng.integers(0, 60, 3000)] + rng.normal(size=(3000, 24)) * 0.12
    queries = centres[rng.integers(0, 60, 40)] + rng.normal(size=(40, 24)) * 0.12
    got, compared, index = run(spark, queries, vectors, 5)
    assert got == brute(queries, vectors, 5)
    assert sum(compared.values()) < 40 * 3000 / 10
    assert index.rows.count() == 3000


@pytest.mark.parametrize("n_cells", [None, 1, 40])
def test_vectors_without_any_grouping(spark, n_cells):
    rng = np.random.default_rng(6)
    vectors, queries = rng.normal(size=(500, 16)), rng.normal(size=(12, 16))
    got, compared, _ = run(spark, queries, vectors, 7, n_cells=n_cells)
    assert got == brute(queries, vectors, 7)
    assert max(compared.values()) <= 500


def test_copies_zeros_and_blocks(spark, monkeypatch):
    """A third of all vectors are copies, asked for by most questions; blocks are small."""
    monkeypatch.setattr(vi, "BLOCK_VECTORS", 50)
    rng = np.random.default_rng(7)
    vectors, queries = rng.normal(size=(400, 8)), rng.normal(size=(30, 8))
    vectors[::3] = vectors[0]
    vectors[5], vectors[7], queries[3] = 0, 0, 0
    queries[10:] = vectors[0]
    got, _, _ = run(spark, queries, vectors, 6, block_queries=4)
    assert got == brute(queries, vectors, 6)


def test_few_no_and_null_vectors(spark):
    rng = np.random.default_rng(8)
    vectors, queries = rng.normal(size=(3, 4)), rng.normal(size=(2, 4))
    got, compared, _ = run(spark, queries, vectors, 5)
    assert got == brute(queries, vectors, 5) and set(compared.values()) == {3}
    assert run(spark, queries, vectors[:0], 5)[0] == {}
    assert run(spark, queries[:0], vectors, 5)[0] == {}
    nulls = spark.createDataFrame([(1, None), (2, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    hits, _ = vi.search(vi.build_index(nulls), nulls, 3, query_id="vec_id")
    assert [tuple(r)[:3] for r in hits.collect()] == [(2, 1, 2)]
