"""The two numeric helpers that run inside a task or on three numbers, by brute force."""

from itertools import combinations, permutations

import leaf_shapley
import numpy as np
import pandas as pd
import pytest

from creditloom.operators import drivers
from creditloom.operators.drift import exact_p


def _random_tree(features, depth, seed):
    rng, nodes = np.random.default_rng(seed), []

    def grow(level, cover):
        me = len(nodes)
        nodes.append([-1, 0.0, me, me, rng.random(), cover])
        if level < depth and rng.random() < 0.85:
            share = rng.uniform(0.2, 0.8)
            feature, cut = int(rng.integers(features)), rng.normal()
            left, right = grow(level + 1, cover * share), grow(level + 1, cover * (1 - share))
            value = share * nodes[left][4] + (1 - share) * nodes[right][4]
            nodes[me] = [feature, cut, left, right, value, cover]
        return me

    grow(0, 100.0)
    a = np.array(nodes)
    ints = [a[:, i].astype(int) for i in (0, 2, 3)]
    return drivers.ForestTable(
        np.array([0]), ints[0], a[:, 1], ints[1], ints[2], a[:, 4], a[:, 5], depth
    )


def _shapley(tree, x):
    widths = [drivers._features_on_a_path(tree, root) for root in tree.roots]
    return drivers._shapley_contributions(tree, widths, x)


def _expected(tree, x, known, node=0):
    """Tree value when only some features are known, the others averaged by cover."""
    if tree.feature[node] < 0:
        return tree.value[node]
    left, right = tree.left[node], tree.right[node]
    if tree.feature[node] in known:
        child = left if x[tree.feature[node]] <= tree.threshold[node] else right
        return _expected(tree, x, known, child)
    parts = [tree.cover[c] * _expected(tree, x, known, c) for c in (left, right)]
    return sum(parts) / tree.cover[node]


@pytest.mark.parametrize("seed", range(8))
def test_shapley_values(seed):
    features = 4
    tree = _random_tree(features, 5, seed)
    x = np.random.default_rng(seed + 100).normal(size=(4, features))
    got = _shapley(tree, x)
    assert np.allclose(got, leaf_shapley.contributions(tree, x), atol=1e-12)
    for row, phi in zip(x, got):
        want = np.zeros(features)
        orders = list(permutations(range(features)))
        for order in orders:
            known = set()
            for f in order:
                before = _expected(tree, row, known)
                known = known | {f}
                want[f] += _expected(tree, row, known) - before
        assert np.allclose(want / len(orders), phi)
        total = drivers.base_value(tree) + phi.sum()
        assert total == pytest.approx(_expected(tree, row, set(range(features))))


@pytest.mark.parametrize("features", [5, 14])
def test_shapley_values_of_deep_trees(features):
    """Few features come back on a path often, many give long paths; in blocks of any size."""
    tree = _random_tree(features, 12, 2)
    assert (drivers._features_on_a_path(tree, 0) > 8) == (features > 8)
    x = np.random.default_rng(8).normal(size=(2500, features))
    got = _shapley(tree, x)
    assert np.abs(got[:40] - leaf_shapley.contributions(tree, x[:40])).max() < 1e-12
    blocks = (x[i : i + 20] for i in range(0, 2500, 20))
    assert np.allclose(got, np.vstack([_shapley(tree, b) for b in blocks]), atol=1e-12)


@pytest.mark.parametrize("seed", range(3))
def test_path_contributions_add_up(seed):
    tree = _random_tree(4, 5, seed)
    x = np.random.default_rng(seed).normal(size=(20, 4))
    parts = drivers._path_contributions(tree, x)
    for row, phi in zip(x, parts):
        want = _expected(tree, row, set(range(4)))
        assert drivers.base_value(tree) + phi.sum() == pytest.approx(want)


@pytest.mark.parametrize("n,m", [(5, 7), (4, 4), (6, 5), (3, 8)])
def test_exact_p_value(n, m):
    gaps = []
    for chosen in combinations(range(n + m), n):
        i = j = top = 0
        for k in range(n + m):
            i, j = (i + 1, j) if k in chosen else (i, j + 1)
            top = max(top, abs(i * m - j * n))
        gaps.append(top)
    for gap in sorted(set(gaps)):
        want = sum(g >= gap for g in gaps) / len(gaps)
        assert exact_p(gap / (n * m), n, m) == pytest.approx(want)
    assert exact_p(0.0, n, m) == 1.0


def test_shapley_values_of_many_rows(monkeypatch):
    """Many rows look their parts up in tables of the subtrees and never walk down all nodes."""
    tree = _random_tree(9, 8, 2)
    x = np.random.default_rng(8).normal(size=(9000, 9))
    want = np.vstack([_shapley(tree, x[i : i + 500]) for i in range(0, 9000, 500)])
    monkeypatch.delattr(drivers, "_walk")
    for bits in (drivers._features_on_a_path(tree, 0), 12):
        monkeypatch.setattr(drivers, "_TABLE_BITS", bits)
        got = _shapley(tree, x)
        assert np.abs(got - want).max() < 1e-12
        assert np.abs(got[:40] - leaf_shapley.contributions(tree, x[:40])).max() < 1e-12


@pytest.mark.parametrize("sizes", [[], [0, 3], [5] * 7, [23, 1], [40]])
def test_rows_in_blocks(monkeypatch, sizes):
    monkeypatch.setattr(drivers, "_BLOCK_ROWS", 10)
    ends = np.cumsum([0, *sizes])
    batches = [pd.DataFrame({"n": range(a, b)}) for a, b in zip(ends, ends[1:])]
    blocks = list(drivers._blocks(batches))
    assert [n for b in blocks for n in b["n"]] == list(range(sum(sizes)))
    assert all(len(b) == 10 for b in blocks[:-1]) and all(len(b) < 20 for b in blocks)
    assert len(blocks) < 2 or len(blocks[-1]) >= 10
