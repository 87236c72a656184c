"""Shapley values leaf by leaf: another way to the values of ``drivers``, for comparison."""

from dataclasses import dataclass

import numpy as np

@dataclass(frozen=True)
class LeafTable:
    """The leaves of one tree: value, and per feature on the way there the interval that leads
    to the leaf and the share of training weight inside it.  Short paths are padded with
    slots that change nothing."""

    value: np.ndarray
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def leaf_tables(forest) -> list[LeafTable]:
    """One leaf table per tree of the forest."""
    out = []
    for root in forest.roots:
        leaves, open_nodes = [], [(root, {})]
        while open_nodes:
            node, path = open_nodes.pop()
            feature = forest.feature[node]
            if feature < 0:
                leaves.append((forest.value[node], path))
                continue
            low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
            cut, weight = forest.threshold[node], forest.cover[node]
            for child, lo, hi in (
                (forest.left[node], low, min(high, cut)),
                (forest.right[node], max(low, cut), high),
            ):
                step = (lo, hi, share * forest.cover[child] / weight)
                open_nodes.append((child, {**path, feature: step}))
        width = max(1, *(len(path) for _, path in leaves))
        neutral = (0, -np.inf, np.inf, 1.0)
        cells = [
            [(f, *step) for f, step in path.items()] + [neutral] * (width - len(path))
            for _, path in leaves
        ]
        table = np.array(cells, dtype=np.float64)
        out.append(
            LeafTable(
                np.array([v for v, _ in leaves]),
                table[:, :, 0].astype(np.int64),
                table[:, :, 1],
                table[:, :, 2],
                table[:, :, 3],
            )
        )
    return out


def leaf_shapley(leaf: LeafTable, inside: np.ndarray) -> np.ndarray:
    """Shapley value of every path feature of every leaf; ``inside`` is (rows, leaves, features).

    A leaf with value v is reached with weight prod_k(o_k or z_k): o_k says whether the row
    lies in the interval of feature k, z_k is the share used when k is left out.  Averaging
    over all orders of adding features equals the integral over t in [0, 1] of

        v * (o_j - z_j) * prod_{k != j} (z_k * (1 - t) + o_k * t)

    a polynomial in t, which Gauss-Legendre points integrate exactly.
    """
    inside = inside.astype(np.float64)
    points, weights = np.polynomial.legendre.leggauss((inside.shape[2] + 1) // 2)
    total = np.zeros_like(inside)
    for t, w in zip((points + 1) / 2, weights / 2):
        factor = leaf.share * (1 - t) + inside * t
        total += w * factor.prod(axis=2, keepdims=True) / factor
    return total * (inside - leaf.share) * leaf.value[:, None]


def contributions(forest, x):
    """Shapley values of a forest, every feature of every leaf for itself."""
    out = np.zeros_like(x)
    for leaf in leaf_tables(forest):
        value = x[:, leaf.feature]
        parts = leaf_shapley(leaf, (value > leaf.low) & (value <= leaf.high))
        for cell, feature in np.ndenumerate(leaf.feature):
            out[:, feature] += parts[:, cell[0], cell[1]]
    return out / len(forest.roots)
