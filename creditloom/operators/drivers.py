"""Risk drivers: how much each feature moved a score, the strongest ones, and their wording."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.functions import bands
from creditloom.functions.numbers import round_binary
from creditloom.functions.text import signed, words
from creditloom.operators.model import PdModel, predict_values
from creditloom.operators.training_set import encode
from creditloom.session import spread, stage_path

# List sizes, smallest reported value, directions and wording.
TOP_DRIVERS = 10
MIN_CONTRIBUTION = 1e-6
INCREASES, DECREASES, REDUCES = "increases_risk", "decreases_risk", "reduces_risk"
NARRATIVE = "The primary factors increasing default risk are: %s. Protective factors include: %s."
NO_RISK_FACTORS = "no dominant risk factors"
NO_PROTECTION = "no significant protective factors"
UP_PHRASE = "INCREASES default risk"
DOWN_PHRASE = "DECREASES default risk (protective factor)"

_KEYS = ["application_id", "customer_id"]


# --------------------------------------------------------------------------- attribution


def linear_contributions(
    df: DataFrame, weights: Mapping[str, tuple[float, float]], keep: Sequence[str] = _KEYS
) -> DataFrame:
    """Exact attribution of a linear score: weight * (value - centre) per feature."""
    values = F.array(*[F.col(c).cast("double") for c in weights])
    parts = [
        F.coalesce((F.col(c).cast("double") - centre) * weight, F.lit(0.0))
        for c, (weight, centre) in weights.items()
    ]
    return df.select(*keep, values.alias("values"), F.array(*parts).alias("contributions"))


def regression_weights(model: PdModel) -> dict[str, tuple[float, float]]:
    """Weights of the fitted regression on the original scale: feature -> (weight, mean)."""
    scale = model.scaler.std.toArray()
    weight = model.lr.coefficients.toArray() / np.where(scale > 0, scale, 1.0)
    weight = np.where(scale > 0, weight, 0.0)
    centre = model.scaler.mean.toArray()
    return {
        c: (float(w), float(m)) for c, w, m in zip(model.spec.columns, weight, centre)
    }


@dataclass(frozen=True)
class ForestTable:
    """All trees of a forest as flat arrays; a leaf has feature -1 and points to itself.

    ``value`` is the share of defaults at a node and ``cover`` the weight of its training rows.
    """

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    depth: int


def forest_table(model: RandomForestClassificationModel) -> ForestTable:
    """Read the node table of a fitted forest from its saved form.

    Its size is set by the training profile (trees times nodes per tree), not by the data.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    path = stage_path(spark, "forest")
    model.write().save(path)
    nodes = (
        spark.read.parquet(f"{path}/data")
        .select(
            "treeID",
            "nodeData.id",
            "nodeData.leftChild",
            "nodeData.rightChild",
            "nodeData.split.featureIndex",
            F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
            F.col("nodeData.impurityStats")[1].alias("defaults"),
            F.aggregate("nodeData.impurityStats", F.lit(0.0), lambda a, x: a + x).alias("cover"),
        )
        .orderBy("treeID", "id")
        .toPandas()
    )
    # node ids count up from 0 in each tree, so a row is found at first row of tree + id
    first = nodes.groupby("treeID").size().cumsum().shift(fill_value=0)
    offset = nodes["treeID"].map(first).to_numpy()
    own = np.arange(len(nodes))
    leaf = (nodes["leftChild"] < 0).to_numpy()
    return ForestTable(
        roots=first.to_numpy(),
        feature=np.where(leaf, -1, nodes["featureIndex"].to_numpy()).astype(np.int32),
        threshold=nodes["threshold"].fillna(0.0).to_numpy(dtype=np.float64),
        left=np.where(leaf, own, offset + nodes["leftChild"].to_numpy()),
        right=np.where(leaf, own, offset + nodes["rightChild"].to_numpy()),
        value=(nodes["defaults"] / nodes["cover"]).to_numpy(dtype=np.float64),
        cover=nodes["cover"].to_numpy(dtype=np.float64),
        depth=model.getOrDefault("maxDepth"),
    )


def _path_contributions(forest: ForestTable, x: np.ndarray) -> np.ndarray:
    """Change of the node value at every split on the way down, credited to its feature."""
    out, rows = np.zeros_like(x), np.arange(len(x))
    for root in forest.roots:
        node = np.full(len(x), root)
        for _ in range(forest.depth):
            feature = forest.feature[node]
            if (feature < 0).all():
                break
            goes_left = x[rows, feature] <= forest.threshold[node]
            child = np.where(goes_left, forest.left[node], forest.right[node])
            out[rows, feature] += forest.value[child] - forest.value[node]
            node = child
    return out / len(forest.roots)


def base_value(forest: ForestTable) -> float:
    """Forest probability before any split: mean of the root values."""
    return float(forest.value[forest.roots].mean())


#: Cells (points x rows) of the arrays that a walk down a tree carries.
_WALK_CELLS = 1 << 14


def _features_on_a_path(forest: ForestTable, root: int) -> int:
    """Most different features on any way down a tree."""
    most, open_nodes = 1, [(root, frozenset())]
    while open_nodes:
        node, path = open_nodes.pop()
        most = max(most, len(path))
        if forest.feature[node] >= 0:
            further = path | {forest.feature[node]}
            open_nodes += [(forest.left[node], further), (forest.right[node], further)]
    return most


def _walk(
    forest: ForestTable, root: int, x: np.ndarray, points: np.ndarray, weights: np.ndarray, out: np.ndarray
) -> None:
    """Add the Shapley values of one tree for the columns ``x`` (features x rows) to ``out``.

    A leaf of value v is reached with weight prod_k(o_k or z_k) over the features k on its path:
    o_k says whether the row goes that way at all splits on k, z_k is the share of training weight
    that does, used when k is left out.  Averaging over all orders of adding features equals the
    integral over t in [0, 1] of

        v * (o_j - z_j) * prod_{k != j} (z_k * (1 - t) + o_k * t)

    a polynomial in t, which Gauss-Legendre points integrate exactly.  One walk carries the product
    at these points: going down a split extends it by the factor of its feature (and unwinds the
    one that the feature had from a split above); coming up, the sum over the leaves below gives
    the feature its part.
    """
    at_one = points[:, None]  # arrays are points x rows, so that loops run along the rows
    at_zero, weight = 1.0 - at_one, weights[:, None]

    def down(node: int, product: np.ndarray, path: dict) -> np.ndarray:
        feature = forest.feature[node]
        if feature < 0:
            return product * forest.value[node]
        goes_left = x[feature] <= forest.threshold[node]
        before, share = path.get(feature, (None, 1.0))
        total = None
        for child, goes in ((forest.left[node], goes_left), (forest.right[node], ~goes_left)):
            below = share * forest.cover[child] / forest.cover[node]
            # factor and part of the feature, for rows that do not and that do go its way
            out_now = below * at_zero
            in_now = out_now + at_one
            out_gain, in_gain = -below / out_now * weight, (1.0 - below) / in_now * weight
            if before is None:
                inside = goes
                extend = np.where(goes, in_now, out_now)
                gain = np.where(goes, in_gain, out_gain)
            else:  # rows that were out stay out; the others may go out here
                inside = before & goes
                out_then = share * at_zero
                in_then = out_then + at_one
                lost, held = -share / out_then * weight, (1.0 - share) / in_then * weight
                extend = np.where(
                    inside, in_now / in_then, np.where(before, out_now / in_then, out_now / out_then)
                )
                gain = np.where(
                    inside, in_gain - held, np.where(before, out_gain - held, out_gain - lost)
                )
            extend *= product
            found = down(child, extend, {**path, feature: (inside, below)})
            gain *= found
            out[feature] += gain.sum(axis=0)
            total = found if total is None else total + found
        return total

    down(root, np.ones((len(points), x.shape[1])), {})


#: Bits of a way through a tree that one table of contributions has at most.
_TABLE_BITS = 12
#: Rows that go through the tables of a tree together, and twice as many less one at the end.
_BLOCK_ROWS = 1 << 16
#: Rows of a batch that a task returns.
_ROWS_OUT = 10_000


_GAUSS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _gauss(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights of an integral over [0, 1]."""
    if n not in _GAUSS:
        points, weights = np.polynomial.legendre.leggauss(n)
        _GAUSS[n] = ((points + 1) / 2, weights / 2)
    return _GAUSS[n]


def _inner_nodes(forest: ForestTable) -> np.ndarray:
    """How many splits stand at and below each node."""
    inner = np.zeros(len(forest.feature), np.int64)
    below = [int(root) for root in forest.roots]
    for node in below:  # grows while it is read: parents before children
        if forest.feature[node] >= 0:
            inner[node] = 1
            below += [int(forest.left[node]), int(forest.right[node])]
    for node in reversed(below):
        if forest.feature[node] >= 0:
            inner[node] += inner[forest.left[node]] + inner[forest.right[node]]
    return inner


def _ways(forest: ForestTable, node: int, code: np.ndarray, path: dict, goes_left: Callable, stop: Callable):
    """Nodes below ``node`` where ``stop`` holds, each with its path and the rows' codes there.

    ``path`` has for each feature on the way its place and the share z (see ``_walk``); bit i of
    a code is o of the i-th feature.
    """
    if stop(node, path):
        yield node, code, path
        return
    feature = forest.feature[node]
    left = goes_left(node)
    at, share = path.get(feature, (len(path), 1.0))
    for child, goes in ((forest.left[node], left), (forest.right[node], ~left)):
        if feature in path:
            found = np.where(goes, code, code & np.uint16(0xFFFF ^ (1 << at)))
        else:
            found = code | (goes.astype(np.uint16) << np.uint16(at))
        further = {**path, feature: (at, share * forest.cover[child] / forest.cover[node])}
        yield from _ways(forest, child, found, further, goes_left, stop)


def _leaf_table(value: float, shares: Sequence[float]) -> np.ndarray:
    """Contributions (features x codes) of one leaf, for every code: the integral in ``_walk``."""
    points, weights = _gauss((len(shares) + 1) // 2)
    product = (weights * value)[:, None]
    gains = []
    for share in shares:
        out = share * (1.0 - points)
        within = out + points
        product = np.concatenate([product * out[:, None], product * within[:, None]], axis=1)
        gains += [-share / out, (1.0 - share) / within]
    both = np.stack(gains) @ product
    table = both[0::2]
    for i in range(len(shares)):
        table[i].reshape(-1, 2, 1 << i)[:, 1] = both[2 * i + 1].reshape(-1, 2, 1 << i)[:, 1]
    return table


def _subtree_table(forest: ForestTable, top: int, path: dict) -> tuple[list[int], list[int], np.ndarray]:
    """The splits of a subtree, its features and their contributions (features x codes) summed
    over its leaves.  A code has a bit for each feature on the path, then for each split."""
    splits, open_nodes = [], [int(top)]
    while open_nodes:
        node = open_nodes.pop()
        if forest.feature[node] >= 0:
            splits.append(node)
            open_nodes += [int(forest.left[node]), int(forest.right[node])]
    bit = {node: len(path) + i for i, node in enumerate(splits)}
    features = list(dict.fromkeys([*path, *(forest.feature[node] for node in splits)]))
    place = {f: i for i, f in enumerate(features)}
    every = np.arange(1 << (len(path) + len(splits)))
    table = np.zeros((len(features), len(every)))
    ways = _ways(
        forest,
        top,
        (every & ((1 << len(path)) - 1)).astype(np.uint16),
        path,
        lambda node: (every >> bit[node]) & 1 == 1,
        lambda node, _: forest.feature[node] < 0,
    )
    for leaf, code, on_way in ways:
        if on_way:
            parts = _leaf_table(forest.value[leaf], [share for _, share in on_way.values()])
            at = code.astype(np.intp)
            for f, part in zip(on_way, parts):
                table[place[f]] += part[at]
    return splits, features, table


def _look_up(
    forest: ForestTable, root: int, x: np.ndarray, inner: np.ndarray, bits: int, out: np.ndarray
) -> None:
    """Add the Shapley values of one tree as ``_walk`` does, from tables.

    What a leaf adds depends on one bit per feature of its path, and what a small subtree adds on
    these bits above it and one per split inside.  So the contributions of a subtree are worked
    out once for every such code of up to ``bits`` bits; rows only need their codes.
    """
    tests: dict[tuple[int, float], np.ndarray] = {}

    def goes_left(node: int) -> np.ndarray:
        key = (int(forest.feature[node]), float(forest.threshold[node]))
        if key not in tests:
            tests[key] = x[key[0]] <= key[1]
        return tests[key]

    start = np.zeros(x.shape[1], np.uint16)
    small = lambda node, path: len(path) + inner[node] <= bits
    found = np.empty(x.shape[1])
    for top, code, path in _ways(forest, root, start, {}, goes_left, small):
        splits, features, table = _subtree_table(forest, top, path)
        code = code.copy()
        for i, node in enumerate(splits):
            code |= goes_left(node).astype(np.uint16) << np.uint16(len(path) + i)
        at = code.astype(np.intp)
        for f, parts in zip(features, table):
            out[f] += np.take(parts, at, out=found, mode="clip")


def _shapley_contributions(
    forest: ForestTable, widths: Sequence[int], x: np.ndarray, inner: np.ndarray | None = None
) -> np.ndarray:
    """Shapley values of the forest, features left out being averaged by training weight.

    ``widths`` has the number of features on a path of each tree.  Trees whose tables are well
    smaller than the rows are many go through tables (see ``_look_up``).  For the others the time
    grows with rows x nodes x half the width; rows go in blocks whose arrays stay in the
    processor's cache.
    """
    columns = np.ascontiguousarray(x.T)
    out = np.zeros_like(columns)
    inner = _inner_nodes(forest) if inner is None else inner
    bits = min(_TABLE_BITS, len(x).bit_length() - 3)
    for root, width in zip(forest.roots, widths):
        if width <= bits:
            _look_up(forest, root, columns, inner, bits, out)
            continue
        points, weights = _gauss((width + 1) // 2)
        step = max(1, _WALK_CELLS // len(points))
        for lo in range(0, len(x), step):
            rows = slice(lo, lo + step)
            _walk(forest, root, columns[:, rows], points, weights, out[:, rows])
    return out.T / len(forest.roots)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows in blocks of ``_BLOCK_ROWS``; the last one takes what is left, if under as many."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        while rows >= 2 * _BLOCK_ROWS:
            together = pd.concat(held, ignore_index=True)
            yield together[:_BLOCK_ROWS]
            held, rows = [together[_BLOCK_ROWS:]], rows - _BLOCK_ROWS
    if rows:
        yield pd.concat(held, ignore_index=True)


def tree_contributions(
    frame: DataFrame, model: PdModel, method: str = "shapley", forest: ForestTable | None = None
) -> DataFrame:
    """Additive attribution of the forest: base value + contributions = forest probability.

    ``shapley`` gives Shapley values; ``path`` credits each split on the way down to its
    feature, which is much cheaper.  The node table, whose size is set by the training profile,
    is broadcast once; Spark spreads the rows and a task prepares the trees once.
    """
    forest = forest or forest_table(model.rf)
    if method not in ("shapley", "path"):
        raise ValueError(f"method must be 'shapley' or 'path', not {method!r}")
    shared = frame.sparkSession.sparkContext.broadcast(vars(forest))
    encoded = encode(spread(frame), model.spec, keep=_KEYS).select(
        *_KEYS, F.array(*model.spec.columns).alias("values")
    )
    schema = T.StructType(
        [*encoded.schema.fields, T.StructField("contributions", T.ArrayType(T.DoubleType()))]
    )

    def attribution() -> Callable[[np.ndarray], np.ndarray]:
        trees = ForestTable(**shared.value)
        if method == "path":
            return partial(_path_contributions, trees)
        widths = [_features_on_a_path(trees, root) for root in trees.roots]
        return partial(_shapley_contributions, trees, widths, inner=_inner_nodes(trees))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attribute = attribution()
        for block in _blocks(batches):
            parts = attribute(np.stack(block["values"].to_numpy()))
            for lo in range(0, len(block), _ROWS_OUT):
                rows = slice(lo, lo + _ROWS_OUT)
                yield block[rows].assign(contributions=list(parts[rows]))

    return encoded.mapInPandas(run, schema)


# --------------------------------------------------------------------------- ranking


def _strongest(n: int, smallest: float) -> Column:
    """Order and place of the n strongest drivers of a row, strongest first.

    All features of an application sit in one row, so they are ranked inside the row and
    nothing is shuffled.  Ties keep the feature order.
    """
    numbered = F.transform(
        "contributions", lambda c, i: F.struct((-F.abs(c)).alias("order"), i.alias("place"))
    )
    strong = F.filter(numbered, lambda c: -c["order"] >= smallest) if smallest else numbered
    return F.slice(F.sort_array(strong), 1, n)


def _driver(
    rank: Column, place: Column, features: Sequence[str], digits: int, down: str
) -> list[Column]:
    names = [F.lit(f) for f in features]
    part = F.get("contributions", place)
    return [
        rank.alias("rank"),
        F.get(F.array(*names), place).alias("feature_name"),
        round_binary(F.get("values", place), 4).alias("feature_value"),
        round_binary(part, digits).alias("shap_value"),
        F.when(part > 0, INCREASES).otherwise(down).alias("direction"),
        F.get(F.array(*[words(f) for f in names]), place).alias("label"),
    ]


def driver_lists(
    contributions: DataFrame,
    features: Sequence[str],
    n: int = TOP_DRIVERS,
    digits: int = 6,
    smallest: float = 0.0,
    down: str = DECREASES,
    keep: Sequence[str] = _KEYS,
) -> DataFrame:
    """``drivers``: the n strongest drivers of every row, strongest first."""
    top = F.transform(
        _strongest(n, smallest),
        lambda d, i: F.struct(*_driver(i + 1, d["place"], features, digits, down)),
    )
    return contributions.select(*keep, top.alias("drivers"))


def ranked_drivers(
    contributions: DataFrame,
    features: Sequence[str],
    n: int = TOP_DRIVERS,
    digits: int = 6,
    smallest: float = 0.0,
    down: str = DECREASES,
    keep: Sequence[str] = _KEYS,
) -> DataFrame:
    """One row per driver of :func:`driver_lists`.

    The drivers are worded after they have become rows: functions on array elements are
    interpreted by Spark, columns are compiled.
    """
    placed = contributions.select(
        *keep, "values", "contributions", F.posexplode(_strongest(n, smallest)).alias("_i", "_top")
    )
    return placed.select(
        *keep, *_driver(F.col("_i") + 1, F.col("_top.place"), features, digits, down)
    )


def explanation_rows(
    contributions: DataFrame, features: Sequence[str], n: int = TOP_DRIVERS
) -> DataFrame:
    """Ranked drivers as the explanation view shows them: negligible ones dropped."""
    return ranked_drivers(
        contributions, features, n, digits=5, smallest=MIN_CONTRIBUTION, down=REDUCES
    )


def explain_applications(
    frame: DataFrame, model: PdModel, method: str = "shapley", n: int = TOP_DRIVERS
) -> DataFrame:
    """One row per application: score, label, base value, its drivers and a narrative.

    One pass: the encoded values that were attributed are scored in the same row.
    """
    forest = forest_table(model.rf)
    parts = tree_contributions(frame, model, method, forest)
    scored = predict_values(parts, model, "values")
    lists = driver_lists(
        scored, model.spec.columns, n, digits=5, smallest=MIN_CONTRIBUTION, down=REDUCES,
        keep=["application_id", "pd_probability_ens"],
    )
    shown = F.transform(
        "drivers",
        lambda d: F.struct(
            *[d[c].alias(c) for c in ("rank", "feature_name", "feature_value", "shap_value", "direction")]
        ),
    )
    return lists.select(
        "application_id",
        round_binary(F.col("pd_probability_ens"), 4).alias("pd_score"),
        bands.pd_label(F.col("pd_probability_ens")).alias("pd_label"),
        round_binary(F.lit(base_value(forest)), 5).alias("base_value"),
        shown.alias("top_drivers"),
        _narrative(3, 2),
    )


# --------------------------------------------------------------------------- wording


def _narrative(up: int, down: int) -> Column:
    """Wording of the rising and of the protective factors in ``drivers``, in rank order."""

    def listed(rising: bool, count: int, none: str) -> Column:
        wanted = F.filter("drivers", lambda d: (d["direction"] == INCREASES) == F.lit(rising))
        first = F.transform(
            F.slice(wanted, 1, count),
            lambda d: F.concat(
                words(d["feature_name"]),
                F.lit(" ("),
                F.call_function("format_number", d["feature_value"], F.lit("0.0###")),
                F.lit(")"),
            ),
        )
        text = F.array_join(first, ", ")
        return F.when(text != "", text).otherwise(none)

    return F.format_string(
        NARRATIVE, listed(True, up, NO_RISK_FACTORS), listed(False, down, NO_PROTECTION)
    ).alias("narrative")


def driver_narrative(lists: DataFrame, up: int = 3, down: int = 2) -> DataFrame:
    """Two sentences per application: strongest rising and strongest protective factors.

    ``lists`` has one row per application (see :func:`driver_lists`); nothing is shuffled.
    """
    return lists.select("application_id", _narrative(up, down))


def driver_text(
    lists: DataFrame, n: int = 5, up_phrase: str = UP_PHRASE, down_phrase: str = DOWN_PHRASE
) -> DataFrame:
    """Numbered driver list per application, for a prompt."""
    lines = F.transform(
        F.slice("drivers", 1, n),
        lambda d: F.concat(
            F.lit("  "),
            d["rank"].cast("string"),
            F.lit(". "),
            d["feature_name"],
            F.lit(" (SHAP="),
            signed(d["shap_value"]),
            F.lit(") → "),
            F.when(d["direction"] == INCREASES, up_phrase).otherwise(down_phrase),
        ),
    )
    heading = F.concat(F.lit("Top risk drivers for "), F.col("application_id"), F.lit(":\n"))
    return lists.select(
        "application_id", F.concat(heading, F.array_join(lines, "\n")).alias("driver_text")
    )
